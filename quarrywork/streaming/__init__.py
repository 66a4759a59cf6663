"""Structured Streaming over change events."""
