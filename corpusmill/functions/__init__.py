"""Column expressions: text, numbers, JSON and hashes."""
