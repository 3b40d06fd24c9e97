"""Readers and writers built on Spark's data sources."""
