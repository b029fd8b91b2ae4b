"""Column expressions (strings, numbers, URLs, identifiers, scores)."""
