"""Rows with revisions: the newest of each key, and upserts that know stale rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """The row with the largest revision of each key. Whole rows meet as maxima, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), revision)
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], revision: str = "revision", strict: bool = True, on_stale: str = "ignore") -> DataFrame:
    """current with the changes applied; both are unique by key or not, the largest revision counts.

    A change replaces a row of a smaller revision, and one of the same revision unless ``strict``. Other changes are
    stale: they are passed over, or end the query with an error if on_stale is 'error'.
    """
    if on_stale not in ("ignore", "error"):
        raise ValueError("on_stale must be ignore or error")
    now = newest(current, keys, revision).select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_now"))
    new = newest(changes, keys, revision).select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_new"))
    both = now.join(new, keys, "full")
    rev = lambda side: F.col(side)[revision]
    fresh = rev("_new") > rev("_now") if strict else rev("_new") >= rev("_now")
    stale = F.raise_error(F.lit("a change is not newer than what it changes")).cast(both.schema["_now"].dataType) if on_stale == "error" else F.col("_now")
    kept = F.when(F.col("_new").isNull(), F.col("_now")).when(F.col("_now").isNull() | fresh, F.col("_new")).otherwise(stale)
    out = both.select(*keys, kept.alias("_row"))
    return out.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in current.columns])
