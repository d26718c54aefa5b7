"""Author-disambiguation analytics on Spark."""
