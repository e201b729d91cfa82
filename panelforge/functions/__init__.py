"""Column expressions; built-in functions only."""
