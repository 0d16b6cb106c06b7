"""Column expressions: cleaning, keys and score arithmetic."""
