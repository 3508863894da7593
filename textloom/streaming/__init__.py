"""Streaming of the text engine."""
