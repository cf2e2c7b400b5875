"""millrace: catalogue, recommendation and evaluation analytics as Spark jobs."""
