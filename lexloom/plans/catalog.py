"""All registered queries."""

from . import checks, editions, records, relations, searching, statute, texts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
