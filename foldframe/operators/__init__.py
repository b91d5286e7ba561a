"""Operators on DataFrames: alignment, matching, structures, features, rows, datasets, training."""
