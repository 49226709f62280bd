"""Record-stream dataflows and their quality-of-service analytics as Spark jobs."""
