"""Vellum: DataFrame operators for curating large document and e-book collections."""
