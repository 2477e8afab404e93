"""Training-data operators. Nothing else in the library imports this subpackage."""

from spindrift.operators import stars as components

__all__ = ["components"]
