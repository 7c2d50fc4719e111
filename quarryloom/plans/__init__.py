"""Composed queries and index runs."""
