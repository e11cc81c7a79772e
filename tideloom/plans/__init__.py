"""Whole jobs, and the catalog of queries over the star-schema tables."""
