"""Sources: files, tables of texts, inline scripts, configuration."""
