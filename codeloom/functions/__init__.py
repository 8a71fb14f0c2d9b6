"""Scalar functions as Column expressions, and the few parsers that need Python."""
