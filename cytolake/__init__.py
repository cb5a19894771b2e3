"""DataFrame operators for single-cell read and molecule tables."""
