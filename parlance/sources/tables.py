"""Parquet table scans and the derived line tables the parsers read.

Scans return lazy DataFrames; Catalyst prunes columns and pushes filters into
the parquet reader, so callers select only what they need.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def one_line(c):
    """Text made safe for a one-line TSV field: tabs/newlines -> space."""
    for ch in "\t\r\n":
        c = F.replace(c, F.lit(ch), F.lit(" "))
    return c


def utterance_lines(documents: DataFrame, text_col: str = "text",
                    label_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``utterance<TAB>label`` lines built from a labelled text table."""
    return documents.select(
        F.col(id_col).alias("line_id"),
        F.concat_ws("\t", one_line(F.col(text_col)), F.col(label_col)).alias("value"),
    )


def turn_domain(conv_id: Column) -> Column:
    """Stand-in of the reference's two domains: by conversation (not by role,
    which is the label), none for every third."""
    return F.when(conv_id % 3 == 0, F.lit("nba")).when(conv_id % 3 == 1, F.lit("weather"))


def turn_lines(conversations: DataFrame) -> DataFrame:
    """``utterance<TAB>previousTask<TAB>label[<TAB>domain]`` dialogue lines.

    previousTask is the role of the previous turn of the same conversation
    (``na`` for the first); label is the role; the 4th field is the domain
    (absent when the conversation has none).
    """
    from parlance.operators.context import previous_task

    with_prev = previous_task(conversations, ["conv_id"], ["turn"], "role", out_col="prev_role")
    return with_prev.select(
        F.col("conv_id"), F.col("turn"),
        F.concat_ws("\t", one_line(F.col("text")), F.col("prev_role"), F.col("role"),
                    turn_domain(F.col("conv_id"))).alias("value"),
    )
