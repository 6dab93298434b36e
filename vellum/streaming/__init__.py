"""Vellum streaming."""
