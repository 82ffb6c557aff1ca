"""Label operators: keys (A1), frequency index (A2), index -> label (T9),
one-vs-Other row selection (F3) and one-vs-rest relabelling (F4).

Key sets are label vocabularies (one row per class); everything that scales
with the data is a projection or a generate, never a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import java_trim
from parlance.operators.joins import ranked

# Fixed value of the reference: the negative class name.
OTHER = "Other"


def label_keys(df: DataFrame, label_col: str = "strLabel", exclude: tuple[str, ...] = (OTHER,)) -> DataFrame:
    """{key}: distinct trimmed labels, the negative class excluded (Q11, Q12)."""
    k = df.select(java_trim(F.col(label_col)).alias("key")).distinct()
    if exclude:
        k = k.filter(~F.col("key").isin(list(exclude)))
    return k


def label_index(df: DataFrame, label_col: str = "strLabel") -> DataFrame:
    """{value, n, idx}: StringIndexer order, 0 = most frequent, ties by value.

    Ranked by ranges, so a vocabulary of any size never meets in one task.
    """
    counts = df.groupBy(F.col(label_col).alias("value")).agg(F.count("*").alias("n"))
    return ranked(counts, [F.desc("n"), F.asc("value")]).select("value", "n", F.col("place").cast("double").alias("idx"))


def index_to_label(df: DataFrame, index: DataFrame, idx_col: str = "prediction",
                   out_col: str = "predictedLabel") -> DataFrame:
    """IndexToString as a join with the label index (one row per class).

    No broadcast hint: AQE broadcasts the index from its runtime size and
    falls back to a shuffle join for an unexpectedly large label set.
    """
    lut = index.select(F.col("idx").alias("_idx"), F.col("value").alias(out_col))
    return df.join(lut, F.col(idx_col) == F.col("_idx"), "left").drop("_idx")


def _all_keys(keys: DataFrame) -> Column:
    """All keys as one array, from the key table (a scalar subquery: one row per class)."""
    return keys.agg(F.array_sort(F.collect_set("key")).alias("keys")).scalar()


def one_vs_other(df: DataFrame, keys: DataFrame, label_col: str = "strLabel",
                 other: str = OTHER) -> DataFrame:
    """Rows of every key's training set: label == key, or label == Other.

    {key, ...}: a positive row goes to its own key, an ``Other`` row to every
    key (a generate over the class list; the result has these rows).
    """
    lab = java_trim(F.col(label_col))
    keyed = df.withColumn("_all", _all_keys(keys))
    targets = (F.when(lab == other, F.col("_all"))
               .when(F.array_contains("_all", lab), F.array(lab))
               .otherwise(F.array().cast("array<string>")))
    return (keyed.withColumn("_keys", targets)
            .select(F.explode_outer("_keys").alias("key"), *[c for c in df.columns])
            .filter(F.col("key").isNotNull()))


def one_vs_rest(df: DataFrame, keys: DataFrame, label_col: str = "strLabel",
                other: str = OTHER) -> DataFrame:
    """Every row once per key, relabelled: label == key stays, else Other."""
    lab = java_trim(F.col(label_col))
    out = (df.withColumn("_lab", lab).withColumn("_all", _all_keys(keys))
           .select(F.explode_outer("_all").alias("key"), *df.columns, "_lab")
           .filter(F.col("key").isNotNull()))
    return (out.withColumn(label_col, F.when(F.col("_lab") == F.col("key"), F.col("_lab")).otherwise(F.lit(other)))
            .drop("_lab"))
