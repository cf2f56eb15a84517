"""Shared helpers for building and cutting plans."""
