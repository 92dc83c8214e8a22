"""Column expressions: text, numbers, time steps."""
