"""Structured Streaming entry points to the batch plans."""
