"""Operators over parsed documents."""
