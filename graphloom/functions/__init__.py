"""Column-level functions: keys, text and vectors."""
