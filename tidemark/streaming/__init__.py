"""Incremental maintenance by Structured Streaming."""
