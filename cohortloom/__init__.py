"""Expression-cohort analytics as Spark DataFrame jobs."""
