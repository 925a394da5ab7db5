"""Scalar and array expressions shared by the operators."""
