"""Joins and ranks that no hot key, and no table of many values, puts into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast after they have been counted.
FEW = 10_000


def few(table: DataFrame, limit: int = FEW) -> bool:
    """Whether a table has at most ``limit`` rows (reads no more than that)."""
    return table.limit(limit + 1).count() <= limit


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "left",
             share: int = 1000) -> DataFrame:
    """Join of many rows to one row per ``key``, whatever share of the rows a key has.

    ``right`` has one row per key, with its number of left rows in ``rows``
    (dropped from the result).  Keys with more than ``total / share`` left
    rows are fewer than ``share``, so their table is bounded and broadcast;
    the others are joined by a shuffle in which no key is large.
    """
    heavy = max(1, total // share)
    # a column of its own: a plain one would be renamed on both sides of the joins by the optimizer's deduplication
    hot = F.broadcast(right.where(F.col(rows) > heavy).drop(rows).withColumnRenamed(key, "_hot"))
    marks = F.broadcast(right.where(F.col(rows) > heavy).select(F.col(key).alias("_mark")))
    marked = left.join(marks, F.col(key) == F.col("_mark"), "left")
    much = marked.where(F.col("_mark").isNotNull()).drop("_mark").join(hot, F.col(key) == F.col("_hot")).drop("_hot")
    rest = marked.where(F.col("_mark").isNull()).drop("_mark").join(
        right.where(F.col(rows) <= heavy).drop(rows), key, how)
    return much.unionByName(rest)


def kept_by_key(table: DataFrame, key: str) -> DataFrame:
    """Checkpoint of a table that comes in hash partitions of ``key``: joins and groups by ``key`` do not shuffle it again.

    Rows are sorted by key, too.  Adaptive plans do not say how their result
    is partitioned, so this one write is planned without; a plan that would
    need the key dealt otherwise still shuffles.
    """
    conf, name = table.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return table.sortWithinPartitions(key).checkpoint()
    finally:
        conf.set(name, was)


def ranked(table: DataFrame, order: Sequence[Column], out: str = "place") -> DataFrame:
    """Adds the place (from 0) of each row in ``order``, by ranges: no window over the whole table.

    Rows are sorted by range partitions and written; a row's place is the
    number of rows in the partitions before its own, a number per partition,
    plus its place within its partition.  Rows that ``order`` leaves equal
    come in any order.
    """
    sorted_rows = table.repartitionByRange(*order).sortWithinPartitions(*order)
    # checkpointed, as another run of the sampling range partitioner may cut elsewhere
    at = sorted_rows.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (at.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn(out, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
            .drop("_at", "_part", "_before"))
