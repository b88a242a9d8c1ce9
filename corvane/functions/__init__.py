"""Column expressions: text, vectors, answer metrics."""
