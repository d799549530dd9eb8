"""Composites of operators, and the queries over the driver tables."""
