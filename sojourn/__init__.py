"""Sojourn: booking analytics as PySpark DataFrame operators."""

from sojourn.tables import Tables

__all__ = ["Tables"]
