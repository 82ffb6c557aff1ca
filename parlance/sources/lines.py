"""Parsers of the reference's line formats (S1-S4), as projections.

Each works on any DataFrame with a string ``value`` column: a batch
``spark.read.text`` scan, a derived line table or a ``readStream`` source.
Java ``String.split`` rules apply (trailing empty fields dropped).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import java_trim, split_fields


def _with_fields(lines: DataFrame, value_col: str, out_col: str, keep: tuple[str, ...]) -> DataFrame:
    """{keep..., fields of the line}, split once per line.

    As a generated column: a filter on a plain one is pushed below and makes and splits the line a second time.
    """
    return lines.select(*keep, F.explode_outer(F.array(split_fields(F.col(value_col)))).alias(out_col))


def parse_utterances(lines: DataFrame, min_fields: int = 2, trim_text: bool = True,
                     value_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``utterance<TAB>label`` -> {utterance, strLabel}.

    ``min_fields=2, trim_text=True`` is the intent-set reader (rows with fewer
    fields dropped, both fields trimmed); ``min_fields=1, trim_text=False`` is
    the domain-model reader (label trimmed, text kept as is, a one-field line
    gives a null label instead of an error).
    """
    out = _with_fields(lines, value_col, "_parts", keep)
    if min_fields > 1:
        out = out.filter(F.size("_parts") >= min_fields)
    utt = F.get(F.col("_parts"), 0)
    if trim_text:
        utt = java_trim(utt)
    return out.select(*keep, utt.alias("utterance"),
                      java_trim(F.get(F.col("_parts"), 1)).alias("strLabel"))


def parse_turns(lines: DataFrame, min_fields: int = 3, value_col: str = "value",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Dialogue line -> {utterance, previousTask, strLabel, domain}.

    Rows with fewer than ``min_fields`` fields are dropped; the 4th field
    (domain when training, ``domain:weight`` list when scoring) is null when
    absent.
    """
    return (_with_fields(lines, value_col, "_p", keep)
            .filter(F.size("_p") >= min_fields)
            .select(*keep,
                    F.get(F.col("_p"), 0).alias("utterance"),
                    F.get(F.col("_p"), 1).alias("previousTask"),
                    F.get(F.col("_p"), 2).alias("strLabel"),
                    F.get(F.col("_p"), 3).alias("domain")))


def parse_dictionary(lines: DataFrame, slot_col: str = "slot", order_col: str = "slot_order",
                     value_col: str = "value", drop_last_alias: bool = False) -> DataFrame:
    """``canonical,alias1,alias2,...`` -> {slot, slot_order, alias, canonical}.

    Comma split, rows with <2 fields dropped, everything lower-cased.
    ``drop_last_alias=True`` reproduces the loader that slices off the last
    alias.  A duplicated alias keeps ``min(canonical)`` so results do not
    depend on partitioning.
    """
    parts = split_fields(F.col(value_col), ",")
    last = F.size("_p") - 1 if drop_last_alias else F.size("_p")
    rows = (lines.select(slot_col, order_col, parts.alias("_p"))
            .filter(F.size("_p") > 1)
            .select(slot_col, order_col,
                    F.lower(F.get(F.col("_p"), 0)).alias("canonical"),
                    F.explode(F.slice("_p", 2, F.greatest(last - 1, F.lit(0)))).alias("alias")))
    rows = rows.withColumn("alias", F.lower("alias"))
    return (rows.groupBy(slot_col, order_col, "alias")
            .agg(F.min("canonical").alias("canonical")))
