"""Part of codeloom; see README.md for the layout."""
