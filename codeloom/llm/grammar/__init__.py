"""Bundled grammars, their parse tables and a generalised LR recogniser."""
