"""Structured Streaming over record streams."""
