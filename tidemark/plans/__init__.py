"""plans of the tidemark library."""
