"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import scratch_path

#: A word: a maximal run of characters other than blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quoted(column: str) -> str:
    """A column's name for ``F.col``, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def words(text: Column) -> Column:
    """Words of a text in order (null text: none)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs only the unwritten tasks, and the
    table is computed once however often it is read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "parlance-llm", name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_unit(*cols: Column) -> Column:
    """Deterministic number in [0, 1) from the columns (53 bits of XXH64)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def join_by_key(left: DataFrame, right: DataFrame, key: str, heavy_rows: int,
                weight: str) -> DataFrame:
    """Left join of many rows to one row per ``key``, safe for hot keys.

    ``right`` holds one row per key with its number of left rows in
    ``weight``.  Keys with more than ``heavy_rows`` left rows number fewer
    than (left rows / heavy_rows), so with ``heavy_rows`` a fixed share of all
    rows their table has a bound that does not depend on the data, and it is
    broadcast; all other keys go through an ordinary shuffled join in which
    no key is large.  ``heavy_rows`` must be at least 1.
    """
    heavy = right.where(F.col(weight) > heavy_rows)
    light = right.where(F.col(weight) <= heavy_rows)
    marks = heavy.select(F.col(key).alias("_heavy"))
    is_heavy = left.join(F.broadcast(marks), F.col(key) == F.col("_heavy"), "left")
    hot = (is_heavy.where(F.col("_heavy").isNotNull()).drop("_heavy")
           .join(F.broadcast(heavy), key))
    cold = is_heavy.where(F.col("_heavy").isNull()).drop("_heavy").join(light, key, "left")
    return hot.unionByName(cold)
