"""Logical operators: lazy functions from DataFrames to DataFrames; a strategy argument picks the physical variant."""
