"""Levelled compaction: which segments to merge, and which versions a merge keeps."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reads import newest
from ..schema import Options


class Step(NamedTuple):
    sources: list
    target: int
    complete: bool  #: no older version of any of its keys can be in a segment that isn't merged


def choose(segments: list, options: Options, everything: bool = False) -> Step | None:
    """The next merge, from a manifest's rows: the lowest level that holds ten to the level times the threshold."""
    if everything:
        top = max((s.level for s in segments), default=0)
        return Step(segments, min(top + 1, options.max_levels - 1), True) if len(segments) > 1 else None
    for level in range(options.max_levels - 1):
        here = [s for s in segments if s.level == level]
        if len(here) >= options.l0_threshold * 10**level:
            keyed = [s for s in here if s.min_key is not None]
            low, high = min((s.min_key for s in keyed), default=None), max((s.max_key for s in keyed), default=None)
            meets = lambda s: s.min_key is not None and low is not None and s.max_key >= low and s.min_key <= high
            chosen = here + [s for s in segments if s.level == level + 1 and meets(s)]
            ids = {s.segment_id for s in chosen}
            return Step(chosen, level + 1, not any(meets(s) for s in segments if s.segment_id not in ids))
    return None


def rewrite(log: DataFrame, now: int, complete: bool, retain: int) -> DataFrame:
    """The versions that reads at snapshot ``retain`` or later can still need.

    Per key: versions from ``retain`` on, and the newest below it.  That one, if it is a tombstone or an
    expired put, hides older versions, so it goes only if the merge is complete (none can be elsewhere).
    Older versions always go: it hides them for every snapshot that is kept.
    """
    recent = F.col("seq") >= F.lit(retain)
    older = newest(log.where(~recent))  # planned with a group limit, so a hot key is one row a task
    if complete:
        older = older.where((F.col("op") == "P") & ~F.coalesce(F.col("expires_at") <= F.lit(now), F.lit(False)))
    return log.where(recent).unionByName(older)
