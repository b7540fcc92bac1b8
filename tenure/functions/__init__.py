"""Column builders shared by every query."""
