"""Operators on corpora and record pairs; nothing outside this subpackage imports it."""
