"""Relational operators over sources, tokens and nodes."""
