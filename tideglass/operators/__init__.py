"""Operators of tideglass."""
