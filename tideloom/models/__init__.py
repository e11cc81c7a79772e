"""Forecast models. Every model is an expression over as-of histories, one row per (id, dsr)."""
