"""Analytical modes: each is a function from a catalog and parameters to a DataFrame."""
