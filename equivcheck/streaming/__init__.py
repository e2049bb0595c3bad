"""Structured Streaming forms of the relations."""
