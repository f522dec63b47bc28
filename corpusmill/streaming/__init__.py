"""Incremental screening on Structured Streaming."""
