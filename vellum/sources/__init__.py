"""Vellum sources."""
