"""Operators: DataFrame in, DataFrame out; no actions unless a docstring says so."""
