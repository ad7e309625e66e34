"""Operators: DataFrame to DataFrame, lazy, of built-in expressions."""
