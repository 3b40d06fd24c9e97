"""Platform telemetry analytics as Spark DataFrame operators and streams."""
