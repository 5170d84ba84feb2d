"""Road-network analytics on Spark."""
