"""Column expressions: text, casts, dates, keys and reliability grades."""
