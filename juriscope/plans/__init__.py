"""Composed plans and the registered queries with their SQL."""
