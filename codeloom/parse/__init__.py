"""Definitions and references in source files."""
