"""Name resolution on Spark."""
