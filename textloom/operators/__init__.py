"""Operators of the text engine."""
