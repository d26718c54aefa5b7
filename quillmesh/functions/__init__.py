"""Columns: text, names, vectors, judge answers."""
