"""Readers, writers and report parameters."""
