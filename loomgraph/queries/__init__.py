"""Queries over the test tables, each with its SQL where SQL can express it."""
