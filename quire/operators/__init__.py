"""Relational operators on corpora of papers, and their general forms."""
