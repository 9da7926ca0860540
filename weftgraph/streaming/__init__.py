"""Streaming forms of operators whose input can be a stream."""
