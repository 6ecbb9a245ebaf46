"""Connected components, as the operators of this subpackage call them."""

from __future__ import annotations

from ragloom.operators.components import connected_components

__all__ = ["connected_components"]
