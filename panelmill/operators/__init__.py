"""Relational panel operators: DataFrame in, DataFrame out."""
