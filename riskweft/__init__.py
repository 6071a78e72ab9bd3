"""Payment-risk analytics on Spark."""
