"""Operators: each takes the table bundle (and request frames) and returns lazy DataFrames."""
