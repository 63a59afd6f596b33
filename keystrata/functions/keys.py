"""Key ranges: half-open, in unsigned byte order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_successor(prefix: bytes) -> bytes | None:
    """The least byte string above every string that starts with ``prefix``; None if there is none.

    Trailing FF bytes can't be increased, so they are dropped first; an empty or all-FF prefix has no
    upper bound.
    """
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes((head[-1] + 1,)) if head else None


def in_range(key: Column, start=None, end=None) -> Column:
    """start <= key < end; a None bound is open."""
    found = F.lit(True)
    if start is not None:
        found = found & (key >= F.lit(start))
    if end is not None:
        found = found & (key < F.lit(end))
    return found


def has_prefix(key: Column, prefix: str | bytes) -> Column:
    """Keys with a prefix, in a form that reaches the Parquet scan: StringStartsWith, or a binary range."""
    if isinstance(prefix, str):
        return key.startswith(prefix)
    return in_range(key, bytes(prefix), prefix_successor(prefix))


def overlaps(min_key: Column, max_key: Column, low: Column, high: Column) -> Column:
    """Whether two closed key ranges meet."""
    return (max_key >= low) & (min_key <= high)
