"""The same rules over event streams."""
