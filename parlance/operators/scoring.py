"""Scoring (F6, C1-C6, J1, L1, U1).

Texts are scored as a table: every model is applied to the same frame in one
pass (featurised once per feature width), each with its own output columns,
then the scores are stacked to long form {id, domain, classifier, score}.
No driver loop over rows, no per-request Spark job.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import linear as LN
from parlance.operators.labels import OTHER
from parlance.operators.train import TextModel, text_feature_stages
from parlance.operators.vectors import hashed_vectors


def score_reference(predicted: Column | str, p0: Column | str, classifier: Column | str) -> Column:
    """The reference's CASE: Other -> 1 - p[0]; classifier -> p[0]; else 0."""
    pl = F.col(predicted) if isinstance(predicted, str) else predicted
    p = F.col(p0) if isinstance(p0, str) else p0
    c = F.lit(classifier) if isinstance(classifier, str) else classifier
    return (F.when(pl == OTHER, 1.0 - p).when(pl == c, p).otherwise(F.lit(0.0))).cast("double")


def score_calibrated(prob: Column | str, labels: Sequence[str], classifier: str) -> Column:
    """P(label == classifier) from the probability vector; 0 if not a label."""
    if classifier not in labels:
        return F.lit(0.0)
    pa = vector_to_array(F.col(prob) if isinstance(prob, str) else prob)
    return pa.getItem(list(labels).index(classifier)).cast("double")


def _classifier_stages(model: PipelineModel):
    """Stages after the feature stages (drop the label indexer: scoring input has no label)."""
    out = []
    for st in model.stages:
        if isinstance(st, StringIndexerModel) and st.getOutputCol() == "label":
            continue
        out.append(st)
    return out


def _split_stages(model: PipelineModel):
    stages = _classifier_stages(model)
    feat, rest = [], []
    for st in stages:
        (rest if rest or hasattr(st, "getProbabilityCol") or hasattr(st, "getClassifier") else feat).append(st)
    return feat, rest


def classify(df: DataFrame, tm: TextModel, mode: str = "calibrated") -> DataFrame:
    """Adds predictedLabel, prob and score of one model."""
    out = PipelineModel(stages=_classifier_stages(tm.model)).transform(df)
    p0 = vector_to_array("probability").getItem(0)
    score = (score_reference("predictedLabel", p0, tm.classifier) if mode == "reference"
             else score_calibrated("probability", tm.labels, tm.classifier))
    return out.withColumn("score", score)


def apply_models(df: DataFrame, models: Sequence[TextModel], text_col: str | dict[str, str] = "utterance",
                 mode: str = "calibrated", features: str | None = None):
    """Apply every model to the same rows in one pass.

    Returns (frame, entries) where entries are (model, predictedLabel column,
    score column), in (domain, classifier) order.  Features are computed once
    per (text column, feature width); ``text_col`` may map a domain to its
    own (e.g. slot-replaced) text column.  ``features`` names a vector column
    that the rows already have; no text is read then.
    """
    col_of = (lambda d: text_col.get(d, "utterance")) if isinstance(text_col, dict) else (lambda d: text_col)
    groups: dict[tuple[str, int], list[TextModel]] = {}
    for tm in models:
        groups.setdefault((col_of(tm.domain), tm.num_features), []).append(tm)
    cur = df
    entries = []
    for gi, ((tcol, width), group) in enumerate(sorted(groups.items())):
        fcol = f"_features_{gi}"
        if features:
            fcol = features
        else:  # same feature stages as at training time, reading this group's text column
            tmp = PipelineModel(stages=text_feature_stages(tcol, width)).transform(cur)
            cur = tmp.withColumnRenamed("features", fcol).drop("words", "ngrams", "_bucket_terms")
        for i, tm in enumerate(group):
            _, rest = _split_stages(tm.model)
            tag = f"_{gi}_{i}"
            clf = rest[0].copy()
            clf.setFeaturesCol(fcol)
            clf.setPredictionCol(f"_pred{tag}")
            clf.setProbabilityCol(f"_prob{tag}")
            clf.setRawPredictionCol(f"_raw{tag}")
            cur = clf.transform(cur)
            labels = tm.labels
            lab_arr = F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast("array<string>")
            pred_label = F.element_at(lab_arr, F.col(f"_pred{tag}").cast("int") + 1)
            p0 = vector_to_array(F.col(f"_prob{tag}")).getItem(0)
            score = (score_reference(pred_label, p0, tm.classifier) if mode == "reference"
                     else score_calibrated(F.col(f"_prob{tag}"), labels, tm.classifier))
            entries.append((tm, pred_label, score))
    entries.sort(key=lambda e: (e[0].domain, e[0].classifier))
    return cur, entries


def classify_all(df: DataFrame, models: Sequence[TextModel] | LN.LinearSet, id_cols: Sequence[str] | str,
                 text_col: str | dict[str, str] = "utterance", mode: str = "calibrated",
                 domain_col: str | None = None) -> DataFrame:
    """{id, domain, classifier, predictedLabel, score} for every model.

    Scores are stacked to long form with ``inline``.  With ``domain_col`` a
    row is scored only by the models of its domain (null = all domains).
    """
    if isinstance(models, LN.LinearSet):
        return classify_linear(df, models, id_cols, text_col, domain_col)
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    cur, entries = apply_models(df, models, text_col, mode)
    structs = []
    for tm, pred_label, score in entries:
        keep = F.lit(True)
        if domain_col:
            keep = F.col(domain_col).isNull() | (F.col(domain_col) == tm.domain)
        structs.append(F.when(keep, F.struct(F.lit(tm.domain).alias("domain"),
                                             F.lit(tm.classifier).alias("classifier"),
                                             pred_label.alias("predictedLabel"),
                                             score.alias("score"))))
    return (cur.select(*ids, F.inline_outer(F.array(*structs)))
            .filter(F.col("classifier").isNotNull()))


def stacked_scores(df: DataFrame, models: Sequence[TextModel] | LN.LinearSet, text_col: str | dict[str, str] = "utterance",
                   out_col: str = "scores", pairs_col: str | None = None, domain_col: str | None = None,
                   mode: str = "calibrated") -> DataFrame:
    """Wide form: the scores of all models as one array<double> per row,
    ordered by (domain, classifier) (C4/L2 without a group-by), optionally
    also as (label, score) pairs restricted to the row's domain."""
    keep_cols = df.columns
    if isinstance(models, LN.LinearSet):
        cur, parts, models = linear_parts(df, models, text_col)
        out = LN.scores(cur, parts, out_col)
        return out.withColumn(pairs_col, LN.pairs(models, out_col, domain_col)) if pairs_col else out
    cur, entries = apply_models(df, models, text_col, mode)
    out = cur.withColumn(out_col, F.array(*[sc.cast("double") for _, _, sc in entries]))
    extra = [out_col]
    if pairs_col:
        pairs = []
        for tm, _, sc in entries:
            p = F.struct(F.lit(tm.classifier).alias("label"), sc.cast("double").alias("score"))
            if domain_col:
                p = F.when(F.col(domain_col).isNull() | (F.col(domain_col) == tm.domain), p)
            pairs.append(p)
        out = out.withColumn(pairs_col, F.filter(F.array(*pairs), lambda x: x.isNotNull()))
        extra.append(pairs_col)
    return out.select(*keep_cols, *extra)


def top_scores(scores: DataFrame, id_col: str, k: int, score_col: str = "score",
               name_col: str = "classifier") -> DataFrame:
    """L1: the k best classifiers per id (ties by name); a group is one id's scores."""
    w = Window.partitionBy(id_col).orderBy(F.desc(score_col), F.asc(name_col))
    return (scores.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def union_scores(*frames: DataFrame) -> DataFrame:
    """Concatenate score lists of several domains."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- sets of linear models
def linear_parts(df: DataFrame, models: LN.LinearSet, text_col: str | dict[str, str] = "utterance",
                 features: str | None = None) -> tuple[DataFrame, list, LN.LinearSet]:
    """The rows with a feature column per text column that the set's domains read, the parts for ``LN.scores``, and
    the set in the order of the scores."""
    of = {d: text_col.get(d, "utterance") if isinstance(text_col, dict) else text_col for d in dict.fromkeys(models.domains)}
    order = sorted(range(len(models)), key=lambda i: (models.domains[i], models.classifiers[i]))
    models = LN.subset(models, order)
    made = {text: features or f"_features_{i}" for i, text in enumerate(dict.fromkeys(of[d] for d in sorted(of)))}
    # the same vectors as at training time, of each text column that some domain reads
    cur = df if features else hashed_vectors(df, {v: text for text, v in made.items()}, models.width)
    parts = [(made[of[d]], LN.subset(models, [i for i, x in enumerate(models.domains) if x == d])) for d in sorted(of)]
    return cur, parts, models


def classify_linear(df: DataFrame, models: LN.LinearSet, id_cols: Sequence[str] | str,
                    text_col: str | dict[str, str] = "utterance", domain_col: str | None = None,
                    features: str | None = None) -> DataFrame:
    """J1/C2/C6 for a set of any number of linear models: {id, domain, classifier, predictedLabel, score}."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    cur, parts, models = linear_parts(df, models, text_col, features)
    keep = list(dict.fromkeys([*ids, *([domain_col] if domain_col else []), *[c for c, _ in parts]]))
    return LN.long_form(LN.scores(cur.select(*keep), parts), models, ids, domain_col=domain_col)


def margins_by_join(texts: DataFrame, tf: DataFrame, id_col: str, coefficients: np.ndarray, intercepts: np.ndarray,
                    block: int = 256) -> DataFrame:
    """{id, place, margin} of K linear models for every row of ``texts``, from its long hashed term frequencies
    {id, bucket, tf} (``features.hashed_tf`` with the models' width).

    The coefficients are a table with a row per bucket and block of models,
    each a vector; a text's margins are the sums of the vectors of its buckets,
    weighted by frequency: one join and one aggregation, and a plan that does
    not grow with the models.  A text without bigrams has the intercepts; no
    cross join.
    """
    spark, k = texts.sparkSession, len(intercepts)
    blocks = max(1, -(-k // block))
    rows = {"bucket": [], "block": [], "weights": []}
    for b in range(blocks):
        part = coefficients[b * block:(b + 1) * block].T
        used = np.flatnonzero(part.any(1))
        rows["bucket"].append(used)
        rows["block"].append(np.full(len(used), b))
        rows["weights"] += list(part[used])
    table = spark.createDataFrame(pa.table({
        "bucket": pa.array(np.concatenate(rows["bucket"]), pa.int32()),
        "block": pa.array(np.concatenate(rows["block"]), pa.int32()),
        "weights": pa.array(rows["weights"], pa.list_(pa.float64()))}))
    heads = spark.createDataFrame(pa.table({
        "block": pa.array(range(blocks), pa.int32()),
        "intercepts": pa.array([intercepts[b * block:(b + 1) * block] for b in range(blocks)], pa.list_(pa.float64()))}))
    sums = (tf.join(table, "bucket").groupBy(id_col, "block")
            .agg(Summarizer.sum(array_to_vector("weights"), F.col("tf").cast("double")).alias("sums")))
    every = texts.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    j = every.join(sums, [id_col, "block"], "left").join(heads, "block")
    margin = F.when(F.col("sums").isNull(), F.col("intercepts")).otherwise(
        F.zip_with(vector_to_array("sums"), "intercepts", lambda a, b: a + b))
    return (j.select(id_col, "block", F.posexplode(margin).alias("_at", "margin"))
            .select(id_col, (F.col("block") * block + F.col("_at")).alias("place"), "margin"))


def sigmoid(margin: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.col(margin) if isinstance(margin, str) else margin)))


def score_lr_by_join(texts: DataFrame, tf: DataFrame, id_col: str, models: LN.LinearSet) -> DataFrame:
    """{id, domain, classifier, score}: P(classifier) of every model of a set, by ``margins_by_join``."""
    margins = margins_by_join(texts, tf, id_col, models.coefficients, models.intercepts)
    return margins.join(LN.names(texts.sparkSession, models), "place").select(
        id_col, "domain", "classifier", sigmoid("margin").alias("score"))


def linear_form(model) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, intercepts) of Spark's logistic regression, its one-vs-rest, or a list of the former.

    A row per class; one row, that of the second class, for a binary model.
    """
    if hasattr(model, "models"):
        each = [linear_form(m) for m in model.models]
        return np.concatenate([w for w, _ in each]), np.concatenate([b for _, b in each])
    return model.coefficientMatrix.toArray(), model.interceptVector.toArray()
