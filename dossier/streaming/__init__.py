"""Structured Streaming twins of the log and document operators."""
