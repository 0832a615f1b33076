"""Table profiling and financial analysis as Spark DataFrame jobs."""
