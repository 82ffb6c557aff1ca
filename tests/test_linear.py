"""Many logistic regressions in one fit: equal to single fits, proved by their gradients, scored by one plan."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from parlance.operators import linear as LN
from parlance.operators import scoring as SC
from parlance.operators import train as TR
from parlance.plans import models as M
from tests.conftest import SF0001

REG = 0.3


def toy(spark, n=400, width=30, labels=("a", "b", "c", "Other"), seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = labels[int(rng.integers(len(labels)))]
        at = sorted({int(x) for x in rng.integers(0, width - 2, 6)} | {3 * labels.index(label)})
        rows.append((Vectors.sparse(width, [(k, float(rng.integers(1, 4))) for k in at]), label, ["x", "y"][i % 2]))
    rows.append((Vectors.sparse(width, []), "a", "x"))
    rows.append((Vectors.dense([1.0] * width), "b", "y"))
    return spark.createDataFrame(rows, ["features", "label", "group"]).repartition(3)


def single(rows, key):
    """Spark's own fit of one key, to convergence."""
    df = rows.select("features", (F.col("label") == key).cast("double").alias("label"))
    m = LogisticRegression(maxIter=500, tol=1e-14, regParam=REG).fit(df)
    return m.coefficients.toArray(), m.intercept


def test_one_fit_equals_single_fits(spark):
    rows = toy(spark)
    keys = LN.Keys(("a", "b", "c"), (None,) * 3)
    models, _ = LN.fit(rows, keys, 30, REG, tol=1e-10)
    for i, k in enumerate(keys.labels):
        w, b = single(rows, k)
        assert np.abs(models.coefficients[i] - w).max() < 1e-6 and abs(models.intercepts[i] - b) < 1e-6


def test_groups_and_negatives_equal_filtered_single_fits(spark):
    rows = toy(spark)
    keys = LN.Keys(("a", "b", "a"), ("x", "x", "y"), "Other")
    models, _ = LN.fit(rows, keys, 30, REG, tol=1e-10)
    for i, (k, g) in enumerate(zip(keys.labels, keys.groups, strict=True)):
        w, b = single(rows.where((F.col("group") == g) & F.col("label").isin(k, "Other")), k)
        assert np.abs(models.coefficients[i] - w).max() < 1e-6 and abs(models.intercepts[i] - b) < 1e-6


def test_vectors_are_converted_once_for_all_passes(spark, monkeypatch):
    """Passes read packed blocks: far fewer rows than there are training rows, and the same sums."""
    rows, keys = toy(spark), LN.Keys(("a", "b"), ("x", "y"), "Other")
    calls = []
    monkeypatch.setattr(LN, "pack", lambda r, k, f=LN.pack: calls.append(f(r, k)) or calls[-1])
    models, scans = LN.fit(rows, keys, 30, REG)
    assert len(calls) == 1 and scans > 3
    blocks = calls[0].blocks.collect()
    assert len(blocks) <= 4 and sum(b["n"] for b in blocks) == rows.count()
    n = LN.Pass(calls[0], keys, 30).moments()[0]
    assert n.tolist() == [rows.where(f"group = '{g}' and label in ('{k}', 'Other')").count()
                          for k, g in zip(keys.labels, keys.groups, strict=True)]


def test_scans_do_not_grow_with_the_models(spark):
    rows = toy(spark)
    one = LN.fit(rows, LN.Keys(("a",), (None,)), 30, REG)[1]
    many = LN.fit(rows, LN.Keys(("a", "b", "c", "Other") * 10, (None,) * 40), 30, REG)[1]
    each = [LN.fit(rows, LN.Keys((k,), (None,)), 30, REG)[1] for k in ("b", "c", "Other")]
    assert many <= max(one, *each) + 1


def test_one_class_and_no_rows(spark):
    rows = toy(spark)
    models, _ = LN.fit(rows, LN.Keys(("a", "never"), (None, None)), 30, REG)
    assert models.intercepts[1] == -np.inf and not models.coefficients[1].any()
    assert LN.residuals(rows, LN.Keys(("never",), (None,)), LN.subset(models, [1]), REG)[0] == 0
    models, _ = LN.fit(rows.limit(0), LN.Keys(("a",), (None,)), 30, REG)
    assert models.intercepts[0] == -np.inf


def perturbed(models, by=1.05):
    return LN.LinearSet(models.domains, models.classifiers, models.coefficients * by, models.intercepts)


@pytest.mark.parametrize("change", [
    lambda w, b: (w * 1.01, b), lambda w, b: (w, b + 0.01), lambda w, b: (w[::-1].copy(), b[::-1].copy()),
    lambda w, b: (0 * w, b), lambda w, b: (-w, -b)])
def test_residuals_tell_fits_from_others(spark, change):
    rows, keys = toy(spark), LN.Keys(("a", "b", "c"), (None,) * 3)
    models, _ = LN.fit(rows, keys, 30, REG)
    assert LN.residuals(rows, keys, models, REG).max() < M.CONVERGED
    w, b = change(models.coefficients, models.intercepts)
    if np.array_equal(w[1], models.coefficients[1]):
        w, b = w[[0, 2]], b[[0, 2]]  # the middle model of the reversed set is itself
        keys = LN.Keys(("a", "c"), (None,) * 2)
    other = LN.LinearSet(("",) * len(w), keys.labels, w, b)
    assert LN.residuals(rows, keys, other, REG).min() > M.CONVERGED


def test_coefficient_of_a_constant_feature_is_no_fit(spark):
    rows, keys = toy(spark), LN.Keys(("a",), (None,))
    models, _ = LN.fit(rows, keys, 31, REG)
    models.coefficients[0, 30] = 0.5
    assert LN.residuals(rows, keys, models, REG)[0] > M.CONVERGED


def test_two_thousand_models_score_as_single_ones_by_one_plan(spark):
    rng = np.random.default_rng(1)
    rows = toy(spark, 40).select("features", F.monotonically_increasing_id().alias("id")).cache()

    def scored(k):
        models = LN.LinearSet(("d",) * k, tuple(f"c{i:05d}" for i in range(k)), rng.normal(size=(k, 30)), rng.normal(size=k))
        return models, LN.scores(rows, [("features", models)])

    models, out = scored(2000)
    matrix = {r["id"]: r["features"].toArray() for r in rows.collect()}
    for r in out.collect():
        want = 1 / (1 + np.exp(-(models.coefficients @ matrix[r["id"]] + models.intercepts)))
        assert np.abs(np.array(r["scores"]) - want).max() < 1e-12
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(scored(2)[1]) - size(out)) < 50
    long = LN.long_form(out, models, ["id"])
    assert long.count() == 2000 * len(matrix)


def test_margins_by_join_equal_products_in_blocks(spark):
    rng = np.random.default_rng(2)
    k, width = 23, 30
    w, b = rng.normal(size=(k, width)) * (rng.random((k, width)) < 0.5), rng.normal(size=k)
    tf = spark.createDataFrame([(i, int(x), int(c)) for i in range(8) for x, c in
                                zip(rng.choice(width, 5, False), rng.integers(1, 4, 5), strict=True)], "id long, bucket int, tf long")
    texts = spark.range(10)  # two without a bigram
    got = {(r["id"], r["place"]): r["margin"] for r in SC.margins_by_join(texts, tf, "id", w, b, block=4).collect()}
    x = np.zeros((10, width))
    for r in tf.collect():
        x[r["id"], r["bucket"]] += r["tf"]
    want = x @ w.T + b
    assert len(got) == 10 * k and all(abs(want[i, p] - m) < 1e-9 for (i, p), m in got.items())


# ---------------------------------------------------------------- the jobs' proofs fail for other models
def test_fits_of_the_jobs_are_proved_and_others_are_not(spark):
    for name, train, ovr in (("domain-lr", M.train_domain(), False), ("domain-ovr", M.train_domain("ovr_lr"), True)):
        tm = M.trained(spark, SF0001, name, train)[0]
        w, b = SC.linear_form(M._lr(tm))
        assert max(M.domain_residuals(spark, SF0001, tm.labels, w, b, ovr).values()) <= M.CONVERGED
        for other in ((1.3 * w, b), (-w, b), (np.roll(w, 1, 0), np.roll(b, 1)), (0 * w, b)):
            assert max(M.domain_residuals(spark, SF0001, tm.labels, *other, ovr).values()) > M.CONVERGED, name
    models = M.intent_models(spark, SF0001)
    assert max(M.intent_residuals(spark, SF0001, models).values()) <= M.CONVERGED
    assert min(M.intent_residuals(spark, SF0001, perturbed(models)).values()) > M.CONVERGED
    models = M.one_vs_rest_models(spark, SF0001)
    assert max(M.language_residuals(spark, SF0001, models).values()) <= M.CONVERGED
    assert min(M.language_residuals(spark, SF0001, perturbed(models)).values()) > M.CONVERGED


def test_scores_of_the_jobs_are_proved_and_others_are_not(spark):
    texts = M.benchmark_texts(spark, SF0001)
    slots = M.slot_text(spark, texts)
    models = M.intent_models(spark, SF0001)
    ok = lambda df, col="ok": [r[col] for r in df.collect()]
    assert all(ok(M.classify_all_checked(slots, models, models)))
    assert not all(ok(M.classify_all_checked(slots, perturbed(models, 1.001), models)))
    tm = M.domain_model(spark, SF0001)
    w, b = SC.linear_form(M._lr(tm))
    assert all(ok(M.classify_checked(texts, tm, w, b)))
    assert not any(ok(M.classify_checked(texts, tm, 1.01 * w, b)))
    ovr = M.trained(spark, SF0001, "domain-ovr", M.train_domain("ovr_lr"))[0]
    w, b = SC.linear_form(M._lr(ovr))
    assert all(ok(M.batch_predict_checked(texts, ovr, w, b), "known"))
    assert not all(ok(M.batch_predict_checked(texts, ovr, np.roll(w, 1, 0), np.roll(b, 1)), "known"))
    keys = ["item_id", "domain", "classifier"]
    langs = M.one_vs_rest_models(spark, SF0001)
    again = M.scores_by_join(texts, perturbed(langs, 1.001), "item_id")
    assert not all(ok(M.same_scores(M.multi_classify(spark, SF0001), again, keys)))


def test_forest_proofs(spark):
    from parlance.operators import forest as FO
    tm = M.task_text_model(spark, SF0001)
    assert max(M.task_deviations(spark, SF0001, tm).values()) <= M.LEAF_DEVIATIONS
    rows = M.task_vectors(tm.model, M.task_frame(spark, SF0001).filter("is_train")).select("features", "label")
    forest = M._forests(tm.model)[0]
    binary = rows.select("features", (F.col("label") == 0).cast("int").alias("label"))
    trees = FO.read_trees(spark, forest)
    counts = FO.leaf_counts(binary, trees)
    assert FO.leaf_deviation(counts[:, ::-1], trees) > M.LEAF_DEVIATIONS  # the classes exchanged
    moved = counts.copy()
    moved[trees.leaves] = np.roll(counts[trees.leaves], 1, 0)  # every leaf has its neighbour's rows
    assert FO.leaf_deviation(moved, trees) > M.LEAF_DEVIATIONS
    assert FO.leaf_deviation(100 * counts, trees) > M.LEAF_DEVIATIONS
    # the nodes' own evaluation is the model's
    got = forest.transform(binary).select("features", "rawPrediction", F.col("prediction")).collect()
    x = np.array([r["features"].toArray() for r in got])
    assert np.abs(FO.votes(trees, x) - np.array([r["rawPrediction"].toArray() for r in got])).max() < 1e-9


def test_task_answers_are_proved(spark):
    from parlance.operators import forest as FO
    tm = M.task_text_model(spark, SF0001)
    forests = [FO.read_trees(spark, f) for f in M._forests(tm.model)]
    requests, ids = M.task_requests(spark, SF0001), ["conv_id", "turn"]
    answers = {tuple(r[:2]): r["predictedLabel"] for r in
               M.classify_task(spark, SF0001, requests).select(*ids, "predictedLabel").collect()}
    again = {tuple(r[:2]): r["label"] for r in M.task_by_nodes(spark, SF0001, requests, tm, forests, ids).collect()}
    assert again == answers
    other = {tuple(r[:2]): r["label"] for r in M.task_by_nodes(spark, SF0001, requests, tm, forests[::-1], ids).collect()}
    assert other != answers


def test_train_intent_set_is_the_single_fit_form(spark):
    """The pipelines fitted one by one give the same scores."""
    frame = M.domain_frame(spark, SF0001)
    keys = list(M.language_keys(spark, SF0001).labels)
    singles = TR.train_intent_set(frame, keys, "lang", TR.DOMAIN_FEATURES)
    texts = M.benchmark_texts(spark, SF0001)
    a = {(r["item_id"], r["classifier"]): r["score"] for r in SC.classify_all(texts, singles, "item_id").collect()}
    b = {(r["item_id"], r["classifier"]): r["score"] for r in M.multi_classify(spark, SF0001).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-3
