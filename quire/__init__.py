"""Quire: book-corpus retrieval, evaluation and training data as Spark DataFrame jobs."""
