"""Relational operators over changes, reviews and their tables."""
