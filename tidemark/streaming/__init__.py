"""Bounded incremental reads as Structured Streaming."""
