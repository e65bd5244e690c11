"""Incremental (Structured Streaming) variants of the batch sources."""
