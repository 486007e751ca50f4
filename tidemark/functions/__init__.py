"""Column types and value conversions as Column expressions."""
