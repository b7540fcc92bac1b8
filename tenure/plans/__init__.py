"""The queries: plain functions from DataFrames to a DataFrame."""
