"""Data preparation for text corpora; nothing else in the library imports it."""
