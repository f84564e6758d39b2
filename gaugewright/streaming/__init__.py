"""Incremental recomputation with Structured Streaming."""
