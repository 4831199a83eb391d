"""Operators for training text. Nothing outside this package imports it."""
