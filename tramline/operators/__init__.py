"""DataFrame operators of the catalogue."""
