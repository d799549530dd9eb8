"""Connected components, as the whole library has them."""

from kgloom.operators.components import components

__all__ = ["components"]
