"""Readers of corpora and writers of results."""
