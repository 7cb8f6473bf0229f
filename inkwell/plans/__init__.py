"""Declared schemas and users, as driver objects and as small tables."""
