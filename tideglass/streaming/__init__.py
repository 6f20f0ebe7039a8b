"""Streaming of tideglass."""
