"""Analytics for two-channel solar X-ray flux series, written as Spark jobs."""
