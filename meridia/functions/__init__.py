"""Column expressions: statistics, vectors, strings."""
