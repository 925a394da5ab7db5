"""Registered queries over the standard tables, each with its SQL oracle where one exists."""
