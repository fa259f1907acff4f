"""Structured Streaming over newly arriving treatments; an extension of this library."""
