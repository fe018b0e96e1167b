"""streaming of the tidemark library."""
