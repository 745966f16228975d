"""Dictionary-driven text analytics on Spark."""
