"""Row-level building blocks that the other operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often the body (and lambdas in it) refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(values: Column) -> Column:
    """An array of strings as an array of (term, tf), by one sort within the row; null for an empty one."""

    def runs(w: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)))
        return bind(first, lambda at: F.transform(F.sequence(F.lit(1), F.size(at)), lambda k: F.struct(F.get(w, F.get(at, k - 1) - 1).alias("term"), (F.coalesce(F.get(at, k), F.size(w) + 1) - F.get(at, k - 1)).alias("tf"))))

    return F.when(F.size(values) > 0, bind(F.array_sort(values), runs))


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest `order` columns, ties broken by the greatest hash of the row, so the same
    row wins however the table is cut or ordered.

    An aggregation, not a window: each task reduces a key to one row before the shuffle, so a key that holds a third
    of the table still moves one row per task. Null keys form one group; null order values count as smallest.
    Columns outside `keys` and `keep` (default: all others) are dropped.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c not in keys]
    if not keep:
        return df.select(*keys).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    rank = F.struct(*[F.col(f"`{c}`") for c in order], *[F.xxhash64(row)], F.lit(0))
    best = df.groupBy(*keys).agg(F.max_by(row, rank).alias("_row"))
    return best.select(*keys, *[F.col("_row").getField(c).alias(c) for c in keep])


def rows_within(df: DataFrame, limit: int) -> bool:
    """Whether `df` has at most `limit` rows; reads no more than it needs to tell."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if rows_within(df, limit) else df
