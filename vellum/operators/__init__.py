"""Vellum operators."""
