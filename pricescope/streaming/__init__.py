"""Streaming twins of the batch rules."""
