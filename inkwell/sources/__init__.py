"""Readers and writers of document trees."""
