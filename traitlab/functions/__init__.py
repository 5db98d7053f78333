"""Scalar helpers: constants, units, numeric rounding, number-to-text."""
