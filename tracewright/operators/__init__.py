"""Relational and graph operators: DataFrame in, DataFrame out."""
