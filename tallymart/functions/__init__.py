"""Column functions: text in, columns out."""
