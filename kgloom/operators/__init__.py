"""Relational operators on documents, triples and graphs."""
