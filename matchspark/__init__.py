"""Football tracking-data analytics as Spark DataFrame operators."""
