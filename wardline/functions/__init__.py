"""Column expressions: dates, text, derived clinical rules and scores."""
