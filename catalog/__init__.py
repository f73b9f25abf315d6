"""The library's operators bound to the given tables, each with its SQL twin."""
