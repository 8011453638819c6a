"""Readers, source selection and record sinks."""
