"""Registered queries and the SQL each is held against."""
