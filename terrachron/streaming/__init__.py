"""Streaming readers of the feeds."""
