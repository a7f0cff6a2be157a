"""Repository-health analytics as Spark DataFrame jobs."""
