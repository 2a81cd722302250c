"""Column functions on text and JSON."""
