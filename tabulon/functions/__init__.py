"""Filing analytics on Spark."""
