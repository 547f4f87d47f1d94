"""streaming of the page engine."""
