"""Evidence-grounded question answering data jobs, expressed as Spark DataFrame operations."""
