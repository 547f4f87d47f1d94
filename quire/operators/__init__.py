"""operators of the page engine."""
