"""Relational operators: DataFrame in, DataFrame out."""
