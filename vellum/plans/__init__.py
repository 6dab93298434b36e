"""Vellum plans."""
