"""Sources of the text engine."""
