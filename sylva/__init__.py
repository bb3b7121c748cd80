"""sylva: source-code analytics on Spark."""
