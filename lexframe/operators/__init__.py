"""Operators on DataFrames. None of them collects data that grows with the tables."""
