"""operators of the tidemark library."""
