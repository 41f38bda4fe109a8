"""Document verification and corpus preparation on Spark."""
