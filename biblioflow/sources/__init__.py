"""Readers of catalogue databases, files, and answers of metadata services."""
