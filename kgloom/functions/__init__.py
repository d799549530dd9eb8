"""Column functions: text cleaning, vectors."""
