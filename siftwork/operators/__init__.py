"""Operators: ``fn(df, ...) -> df`` transforms."""
