"""Column functions: text, progress, signatures, titles."""
