"""Incremental consolidation with Structured Streaming."""
