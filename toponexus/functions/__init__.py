"""Column functions: names, service answers, letters, similarity."""
