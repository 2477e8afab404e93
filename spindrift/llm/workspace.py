"""Intermediate tables of this subpackage, in the shared folder."""

from spindrift.operators.storage import cut, discard, folder, fresh, stored

__all__ = ["cut", "discard", "folder", "fresh", "stored"]
