"""Incremental checkpointing as Structured Streaming."""
