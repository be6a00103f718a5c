"""Operators that prepare text for model training; nothing outside this package imports it."""
