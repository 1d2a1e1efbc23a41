"""Bounded samples of labelled rows, chosen by a 63-bit hash of the id: exact shares at any table size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALL = (1 << 63) - 1


def last_hash(bound: int, rows: int) -> int:
    """The largest hash that is still in a sample of about ``bound`` of ``rows`` rows; all of them, if they are no more."""
    return _ALL if rows <= bound else (bound << 63) // rows - 1


def id_hash(doc_id: str = "doc_id") -> Column:
    """63 bits of a hash of the id."""
    return F.shiftrightunsigned(F.xxhash64(F.col(doc_id)), 1)
