"""functions of the tidemark library."""
