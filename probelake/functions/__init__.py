"""Column functions: text forms, vectors, portable hashes."""
