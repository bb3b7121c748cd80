"""Functions on single sources: lexing, parsing, regular expressions, text positions."""
