"""Corpus preparation for language models: thirteen operators over whole tables.

Nothing outside this package imports it.  Each operator lives in one module
with its general interface; ``queries`` holds the thin registered queries.
"""
