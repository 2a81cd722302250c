"""Document-extraction analytics as Spark jobs."""
