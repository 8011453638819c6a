"""Structured Streaming jobs over arriving files."""
