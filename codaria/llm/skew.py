"""Joins whose hot keys do not meet in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this part of all rows, and more rows than the least; so hot keys are 1/PART at most.
PART, LEAST = 1 / 1000, 256
#: Rows of ids and numbers that may be broadcast, counted first; about 50 MB.
BROADCAST_ROWS = 500_000


def hot_keys(counts: DataFrame, total: int, keys: Sequence[str], n: str = "n") -> DataFrame:
    """The keys whose n in counts is that of a hot key, as a local table: fewer than 1 / PART, if the n sum up to total."""
    found = counts.filter(F.col(n) > max(total * PART, LEAST)).select(*keys)
    return counts.sparkSession.createDataFrame(found.collect(), found.schema)


def spread_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], hot: DataFrame | None = None) -> DataFrame:
    """rows inner joined with table(keys..., one row a key) on keys; null keys don't match.

    Hot keys' rows of table are broadcast, of which there are few by their
    definition, so rows of a hot key stay where they are; all others are dealt by
    key. hot: the hot keys of rows, if they are known. rows is read up to four times.
    """
    keys = list(keys)
    if hot is None:
        hot = hot_keys(rows.groupBy(*keys).agg(F.count("*").alias("n")), rows.count(), keys)
    if hot.isEmpty():
        return rows.join(table, keys)
    few = F.broadcast(hot)
    return rows.join(F.broadcast(table.join(few, keys, "left_semi")), keys).unionByName(rows.join(few, keys, "left_anti").join(table, keys))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it was counted to have at most limit rows."""
    return F.broadcast(df) if df.count() <= limit else df
