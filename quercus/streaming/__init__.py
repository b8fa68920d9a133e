"""Structured Streaming forms of the mergeable sketches."""
