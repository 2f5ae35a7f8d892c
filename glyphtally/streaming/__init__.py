"""Counts of words and pairs over a stream of documents."""
