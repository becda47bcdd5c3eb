"""Data products: each is one function from DataFrames to a DataFrame."""
