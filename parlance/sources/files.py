"""File readers for the reference's on-disk formats.

A user of the reference keeps TSV / comma files; these readers put them into
the same parsers the table jobs use (``spark.read.text`` is a distributed,
splittable scan; nothing is collected).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.sources import lines as L


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines {value, line_id}.

    ``line_id`` is the line's number in file order over all files: files by
    path, splits of a file by their offset, lines by their place in the split.
    Splits are numbered by running sums over one row per split.
    """
    df = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"))  # consecutive within a split
    splits = df.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    starts = splits.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (df.join(starts, ["_file", "_block"])
            .select("value", (F.col("_start") + F.col("_at") - F.col("_first")).alias("line_id")))


def read_utterances(spark: SparkSession, path: str, min_fields: int = 2, trim_text: bool = True) -> DataFrame:
    """``utterance<TAB>label`` file -> {line_id, utterance, strLabel}."""
    return L.parse_utterances(read_lines(spark, path), min_fields=min_fields, trim_text=trim_text,
                              keep=("line_id",))


def read_turns(spark: SparkSession, path: str, min_fields: int = 3) -> DataFrame:
    """S3: dialogue file -> {line_id, utterance, previousTask, strLabel, domain}."""
    return L.parse_turns(read_lines(spark, path), min_fields=min_fields, keep=("line_id",))


def read_dictionary(spark: SparkSession, path: str, slot: str, slot_order: int = 1,
                    drop_last_alias: bool = False) -> DataFrame:
    """``canonical,alias,...`` file -> {slot, slot_order, alias, canonical}."""
    lines = read_lines(spark, path).select(F.lit(slot).alias("slot"), F.lit(slot_order).alias("slot_order"), "value")
    return L.parse_dictionary(lines, drop_last_alias=drop_last_alias)


def read_labelled_csv(spark: SparkSession, path: str, n_columns: int, label_index: int,
                      features_col: str = "features", label_col: str = "label",
                      rejects_col: str | None = None) -> DataFrame:
    """Numeric CSV without header, label at ``label_index`` -> {features, label}.

    A row that is no list of ``n_columns`` numbers fails the job; with
    ``rejects_col`` it is kept instead, with null features and label and the
    line in that column (null for good rows).
    """
    lines = spark.read.text(path)
    numbers = F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("double"))
    rows = lines.select("value", numbers.alias("_x")).withColumn(
        "_good", (F.size("_x") == n_columns) & ~F.exists("_x", lambda x: x.isNull()))
    if rejects_col is None:
        failed = F.raise_error(F.concat(F.lit("not a numeric row: "), F.col("value"))).cast("array<double>")
        rows = rows.withColumn("_x", F.when(F.col("_good"), F.col("_x")).otherwise(failed))
    feats = F.filter("_x", lambda x, i: i != label_index)
    zeros = F.array_repeat(F.lit(0.0), n_columns - 1)  # keeps the vector conversion off bad rows
    out = rows.select(
        F.when(F.col("_good"), array_to_vector(F.when(F.col("_good"), feats).otherwise(zeros))).alias(features_col),
        F.when(F.col("_good"), F.col("_x")[label_index]).alias(label_col),
        F.when(~F.col("_good"), F.col("value")).alias("_reject"))
    return out.drop("_reject") if rejects_col is None else out.withColumnRenamed("_reject", rejects_col)
