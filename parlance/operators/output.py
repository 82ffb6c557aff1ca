"""Response formats (K2-K4) as column expressions.

The reference answers one request at a time with a JSON library; here a whole
score table becomes one response per request id: per-id aggregation of the
score rows (one row per classifier) and ``to_json`` in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T


def _pairs(scores: DataFrame, id_cols: Sequence[str], label_col: str, score_col: str,
           order_cols: Sequence[str]) -> DataFrame:
    entry = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                     F.col(label_col).alias("label"), F.col(score_col).cast("double").alias("score"))
    return (scores.groupBy(*id_cols)
            .agg(F.sort_array(F.collect_list(entry)).alias("_e"))
            .withColumn("_pairs", F.transform("_e", lambda e: F.struct(e["label"].alias("label"),
                                                                         e["score"].alias("score"))))
            .drop("_e"))


def scores_json(pairs: Column | str) -> Column:
    """``{"domainScores":[],"intentScores":[{"label":..,"score":..},..]}``."""
    p = F.col(pairs) if isinstance(pairs, str) else pairs
    empty = F.array().cast("array<struct<label:string,score:double>>")
    return F.to_json(F.struct(empty.alias("domainScores"), p.alias("intentScores")))


def scores_text(pairs: Column | str) -> Column:
    """Scala ``List((label,score), ...).toString``."""
    p = F.col(pairs) if isinstance(pairs, str) else pairs
    items = F.transform(p, lambda e: F.concat(F.lit("("), e["label"], F.lit(","),
                                              e["score"].cast("string"), F.lit(")")))
    return F.concat(F.lit("List("), F.array_join(items, ", "), F.lit(")"))


def format_scores(scores: DataFrame, id_cols: Sequence[str], result_type: str | Column = T.DEFAULT_TYPE,
                  label_col: str = "classifier", score_col: str = "score",
                  order_cols: Sequence[str] = ("domain", "classifier"), out_col: str = "response") -> DataFrame:
    """{id, response}: text form when ``result_type == 'text'``, JSON otherwise."""
    p = _pairs(scores, id_cols, label_col, score_col, order_cols)
    rt = F.lit(result_type) if isinstance(result_type, str) else result_type
    resp = F.when(rt == "text", scores_text("_pairs")).otherwise(scores_json("_pairs"))
    return p.select(*id_cols, resp.alias(out_col))


def task_json(label: Column | str, score: float = 1.0) -> Column:
    """``{"label":..,"score":1.0}`` (the reference always reports 1.0)."""
    lab = F.col(label) if isinstance(label, str) else label
    return F.to_json(F.struct(lab.alias("label"), F.lit(float(score)).alias("score")))


def format_task(df: DataFrame, label_col: str = "predictedLabel", out_col: str = "response") -> DataFrame:
    return df.withColumn(out_col, task_json(label_col))
