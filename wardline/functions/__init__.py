"""Column functions: text, links, signals, redaction and keys."""
