"""Column functions: text, dates, vectors and statistics."""
