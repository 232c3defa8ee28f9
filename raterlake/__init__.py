"""Multi-rater annotation analytics as Spark DataFrame jobs."""
