"""Structured Streaming forms of the corpus scan."""
