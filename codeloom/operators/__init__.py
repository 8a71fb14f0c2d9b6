"""Relational and graph operators over catalog tables."""
