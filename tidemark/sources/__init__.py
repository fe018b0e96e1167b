"""sources of the tidemark library."""
