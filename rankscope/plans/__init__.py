"""End-to-end jobs (Q1-Q6) and the query catalogue used by __spark_entry__."""
