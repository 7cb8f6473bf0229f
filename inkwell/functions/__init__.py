"""Parsing and column functions."""
