"""Readers for the file formats of a code graph."""
