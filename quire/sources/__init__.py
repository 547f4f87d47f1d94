"""sources of the page engine."""
