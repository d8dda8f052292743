"""Column functions: text, dates, ratings, vectors, fuzzy matching."""
