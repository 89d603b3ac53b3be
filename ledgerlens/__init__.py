"""Transfer-stream analytics as Spark DataFrame plans."""
