"""Connected components, shared with the corpus operators."""

from docloom.operators.graph import components

__all__ = ["components"]
