"""Analytical query primitives as lazy DataFrame functions, and operators for training-data pipelines."""
