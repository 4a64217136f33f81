"""Operators on message tables: DataFrames in, DataFrames out."""
