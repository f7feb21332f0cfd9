"""Schema routing analytics as Spark DataFrame operators."""
