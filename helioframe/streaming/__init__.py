"""The same work on unbounded input, as Structured Streaming jobs."""
