"""Operators for cleaning and packing training text. Nothing else in the library imports this package."""
