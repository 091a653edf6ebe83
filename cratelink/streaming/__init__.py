"""Structured Streaming twins of the run operators."""
