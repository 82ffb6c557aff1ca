"""Distributed multi-class metrics (A4-A8), same rules as ``MulticlassMetrics``.

The reference collects all (prediction, label) pairs to the driver.  Here
one aggregation builds the (label, prediction) count table -- partial
aggregation makes its shuffle one row per pair per map task -- and a second
one by class gives all counts, so the scored input is read once and never
self-joined, and the work is linear in the pairs.

Rules: the classes are the *actual* labels; a class only predicted is
missing from the matrix; precision of a never-predicted class is 0; F1 is 0
when precision + recall is 0; FPR is NaN when there is one actual class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 10  # output rounding of the metric columns


def pair_counts(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                by: Sequence[str] = ()) -> DataFrame:
    return (df.groupBy(*by, F.col(label_col).cast("double").alias("label"),
                       F.col(pred_col).cast("double").alias("prediction"))
            .agg(F.count("*").alias("n")))


def confusion(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """{label, prediction, n} over actual labels x actual labels (zeros kept).

    Each label's row takes the list of all labels from a window over the label
    table (one row per class) and adds a zero cell for each, so the pair table
    is read once and the grid is what the result has anyway.
    """
    per = (pair_counts(df, label_col, pred_col).where(F.col("label").isNotNull()).groupBy("label")
           .agg(F.collect_list(F.struct("prediction", "n", F.lit(False).alias("cell"))).alias("cells")))
    per = per.withColumn("classes", F.collect_list("label").over(Window.partitionBy()))
    zeros = F.transform("classes", lambda c: F.struct(
        c.alias("prediction"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("cell")))
    return (per.select("label", F.inline(F.concat("cells", zeros))).groupBy("label", "prediction")
            .agg(F.sum("n").alias("n"), F.max("cell").alias("cell")).where("cell").drop("cell"))


def metrics_by_label(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                     digits: int = DIGITS, by: Sequence[str] = ()) -> DataFrame:
    """{label, n_label, tp, fp, precision, recall, fpr, f1} per actual label (and ``by``, e.g. a model's key).

    Every pair adds to its label's row and to its prediction's row; one
    aggregation by class gives all counts.
    """
    same = F.col("label") == F.col("prediction")
    zero = F.lit(0).cast("long")
    as_label = F.struct(F.col("label").alias("class"), F.col("n").alias("n_label"),
                        F.when(same, F.col("n")).otherwise(zero).alias("tp"), zero.alias("n_pred"))
    as_pred = F.struct(F.col("prediction").alias("class"), zero.alias("n_label"), zero.alias("tp"),
                       F.col("n").alias("n_pred"))
    t = (pair_counts(df, label_col, pred_col, by).select(*by, F.inline(F.array(as_label, as_pred))).groupBy(*by, "class")
         .agg(*[F.sum(c).alias(c) for c in ("n_label", "tp", "n_pred")]))
    # a row per class; all rows count in the total, those of classes that are only predicted with 0
    t = (t.withColumn("total", F.sum("n_label").over(Window.partitionBy(*by)))
         .where((F.col("n_label") > 0) & F.col("class").isNotNull()).withColumnRenamed("class", "label"))
    fp = F.col("n_pred") - F.col("tp")
    precision = F.when(F.col("n_pred") == 0, 0.0).otherwise(F.col("tp") / F.col("n_pred"))
    recall = F.col("tp") / F.col("n_label")
    neg = F.col("total") - F.col("n_label")
    fpr = F.when(neg == 0, F.lit(float("nan"))).otherwise(fp / neg)
    t = (t.withColumn("fp", fp.cast("long"))
         .withColumn("precision", precision).withColumn("recall", recall).withColumn("fpr", fpr))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    t = t.withColumn("f1", f1)
    return t.select(*by, "label", F.col("n_label").cast("long").alias("n_label"), F.col("tp").cast("long").alias("tp"), "fp",
                    *[F.round(c, digits).alias(c) for c in ("precision", "recall", "fpr", "f1")])


def metrics_summary(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                    digits: int = DIGITS, by: Sequence[str] = ()) -> DataFrame:
    """One row (per ``by``): n, accuracy, test_error and label-weighted precision/recall/F1/FPR."""
    per = metrics_by_label(df, label_col, pred_col, digits=17, by=by)
    w = F.col("n_label")
    agg = per.groupBy(*by).agg(
        F.sum("n_label").alias("n"),
        F.sum("tp").alias("_tp"),
        F.sum(F.col("precision") * w).alias("_wp"),
        F.sum(F.col("recall") * w).alias("_wr"),
        F.sum(F.col("f1") * w).alias("_wf"),
        F.sum(F.col("fpr") * w).alias("_wfpr"))
    acc = F.col("_tp") / F.col("n")
    return agg.select(
        *by, F.col("n").cast("long").alias("n"),
        F.round(acc, digits).alias("accuracy"),
        F.round(1 - acc, digits).alias("test_error"),
        F.round(F.col("_wp") / F.col("n"), digits).alias("weighted_precision"),
        F.round(F.col("_wr") / F.col("n"), digits).alias("weighted_recall"),
        F.round(F.col("_wf") / F.col("n"), digits).alias("weighted_f1"),
        F.round(F.col("_wfpr") / F.col("n"), digits).alias("weighted_fpr"))
