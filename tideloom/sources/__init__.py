"""Readers, writers, validation and the panels taken from the star-schema tables."""
