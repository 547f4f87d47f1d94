"""functions of the page engine."""
