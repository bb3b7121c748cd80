"""Findings kept current while documents change."""
