"""Relational operators over opinions, citation groups, edges and rows."""
