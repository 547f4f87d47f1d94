"""plans of the page engine."""
