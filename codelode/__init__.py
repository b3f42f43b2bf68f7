"""Source-code security analytics as Spark DataFrame work."""
