"""DataFrame operators: profiling and financial analysis."""
