"""Watching and incremental streams."""
