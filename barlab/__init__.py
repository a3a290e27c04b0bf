"""barlab: bar-based selection research as Spark DataFrame jobs."""
