"""Connected components of a link table; see the operator."""

from ..operators.components import components

__all__ = ["components"]
