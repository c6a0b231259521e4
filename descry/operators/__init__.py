"""Operators: each takes and returns DataFrames; driver state is at most (columns)^2."""
