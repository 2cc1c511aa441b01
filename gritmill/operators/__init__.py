"""Relational operators: each a plain function from DataFrames to a DataFrame."""
