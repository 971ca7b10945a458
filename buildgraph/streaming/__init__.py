"""Structured Streaming twins of the batch log operators."""
