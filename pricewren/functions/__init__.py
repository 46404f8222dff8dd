"""Column functions: texts, numbers, dates, similarity, vectors, ranks."""
