"""Readers: tables, working trees, language extractors, change listings."""
