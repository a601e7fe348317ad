"""Operators: DataFrames in, DataFrame out, no actions."""
