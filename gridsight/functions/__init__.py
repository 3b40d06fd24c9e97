"""Column expressions: integer arithmetic and text, evaluated in the JVM."""
