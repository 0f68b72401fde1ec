"""Column expressions: missing values and division, metrics."""
