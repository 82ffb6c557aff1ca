"""Feature operators: tokens, n-grams, hashed term frequency, one-hot, assembly.

Hashed TF is computed inside each row (sort + run-length count over the
bucket array): all terms of a document are in one row, so no shuffle is
needed to count them, at any scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T

# Fixed values of the reference: hashed feature widths.
DOMAIN_FEATURES = 5000
INTENT_FEATURES = 10000


def tokenize(df: DataFrame, col: str, out_col: str = "words") -> DataFrame:
    return df.withColumn(out_col, T.tokenize(col))


def ngrams(df: DataFrame, col: str = "words", n: int = 2, out_col: str = "ngrams") -> DataFrame:
    return df.withColumn(out_col, T.ngrams(col, n))


def featurize(df: DataFrame, text_col: str, num_features: int, n: int = 2,
              out_col: str = "tf") -> DataFrame:
    """text -> array<struct<bucket, tf>> sorted by bucket.

    Each intermediate array is its own projection so that it is computed
    once per row (arrays referenced inside lambdas are not re-evaluated).
    """
    return (df.withColumn("_w", T.tokenize(text_col))
            .withColumn("_g", T.ngrams("_w", n))
            .withColumn("_b", F.sort_array(T.bucket_ids("_g", num_features)))
            .withColumn("_st", T.run_flags("_b"))
            .withColumn(out_col, T.run_lengths("_b", "_st"))
            .drop("_w", "_g", "_b", "_st"))


def hashed_tf(df: DataFrame, id_col: str, text_col: str, num_features: int = DOMAIN_FEATURES,
              n: int = 2) -> DataFrame:
    """Long form {id, bucket, tf}: one row per (document, non-empty bucket)."""
    # inline_outer + filter: a plain generator makes the optimizer infer a
    # size(array) > 0 filter and push it through the projections above,
    # which blows up on these nested array expressions.
    return (featurize(df.select(id_col, text_col), text_col, num_features, n)
            .select(id_col, F.inline_outer("tf"))
            .filter(F.col("bucket").isNotNull()))


def one_hot(idx: Column | str, k: Column | int) -> Column:
    """``OneHotEncoder`` with dropLast: k-1 slots, last category all zeros."""
    idx = F.col(idx) if isinstance(idx, str) else idx
    k = F.lit(k) if isinstance(k, int) else k
    vec = F.transform(F.sequence(F.lit(0), k - 2), lambda i: F.when(i == idx, 1.0).otherwise(0.0))
    return F.when(k > 1, vec).otherwise(F.array().cast("array<double>"))


def assemble(*arrays: Column | str) -> Column:
    """``VectorAssembler`` on array<double> columns: concatenation."""
    cols = [F.col(a) if isinstance(a, str) else a for a in arrays]
    return F.concat(*[c.cast("array<double>") for c in cols])


def score_vector(scores: DataFrame, id_cols: Sequence[str], name_cols: Sequence[str] = ("domain", "classifier"),
                 score_col: str = "score", out_col: str = "classifierFeatures") -> DataFrame:
    """Long score table -> per id the scores ordered by (domain, classifier).

    Partial aggregation keeps the shuffle to one row per (id, map task); each
    group holds one score per classifier, so its size is the model count.
    """
    entry = F.struct(*[F.col(c) for c in name_cols], F.col(score_col).cast("double").alias("_s"))
    return (scores.groupBy(*id_cols)
            .agg(F.array_sort(F.collect_list(entry)).alias("_e"))
            .select(*id_cols, F.transform("_e", lambda e: e["_s"]).alias(out_col)))


def contains_counts(df: DataFrame, col: str, needles: Sequence[str]) -> DataFrame:
    """{needle, n_lines}: rows whose text contains each needle, all counted in one pass."""
    counts = [F.count_if(F.col(col).contains(n)).alias(f"_n{i}") for i, n in enumerate(needles)]
    rows = [F.struct(F.lit(n).alias("needle"), F.col(f"_n{i}").alias("n_lines")) for i, n in enumerate(needles)]
    return df.agg(*counts).select(F.inline(F.array(*rows)))
