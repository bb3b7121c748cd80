"""Whole runs: linting, fixing, reports, inferred options."""
