"""Column expressions: text, paths, vectors and formats."""
