"""Structured Streaming forms of stateless and keyed operators."""
