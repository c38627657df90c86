"""Stores that tables are kept in."""
