"""Operator families; each function maps DataFrames to a DataFrame."""
