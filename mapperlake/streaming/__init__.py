"""Incremental analysis by Structured Streaming."""
