"""Plans of the text engine."""
