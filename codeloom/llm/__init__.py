"""Operators for preparing a training corpus; nothing else in the package imports them."""
