"""Operators of a training-data pipeline: duplicates, filters, extraction,
tokens and packing.  Nothing else in the library imports this package."""
