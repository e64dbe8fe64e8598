"""Structured Streaming variants; an addition of our own."""
