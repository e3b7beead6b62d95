"""Column expressions, constants and tail probabilities."""
