"""Vellum functions."""
