"""Operators: DataFrames in, DataFrames out, nothing executed until the caller acts."""
