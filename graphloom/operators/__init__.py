"""Relational, graph, search and maintenance operators over code-graph DataFrames."""
