"""Column functions: normalisers, parsers, similarity."""
