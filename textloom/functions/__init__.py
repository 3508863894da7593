"""Functions of the text engine."""
