"""Structured Streaming entry points (the batch inference plan on arriving files)."""
