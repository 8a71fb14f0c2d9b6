"""Readers that bring files, commits and driver tables into catalog shape."""
