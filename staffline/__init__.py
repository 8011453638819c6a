"""Symbolic-music analytics as PySpark DataFrame jobs."""
