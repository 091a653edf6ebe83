"""Readers and parsers: landed files to typed tables."""
