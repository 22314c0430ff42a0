"""Relational operators of the document model, each a function from DataFrames to a DataFrame."""
