"""Operators: DataFrame in, DataFrame out, built-in expressions only unless a docstring says otherwise."""
