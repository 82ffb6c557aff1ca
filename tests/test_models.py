"""Model and context checks that SQL cannot express (rows-checked jobs)."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from parlance.operators import context as CX
from parlance.operators import scoring as SC
from parlance.operators import split as SP
from parlance.plans import models as M
from parlance.plans import sources as S
from tests.conftest import SF0001


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"item_id", "domain", "classifier", "predictedLabel", "score"}
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)


def test_probabilities_sum_to_one_and_roundtrip(spark, tmp_path):
    tm = M.domain_model(spark, SF0001)
    b = M.benchmark_texts(spark, SF0001)
    out = PipelineModel(stages=SC._classifier_stages(tm.model)).transform(b)
    for r in out.select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x).alias("s")).collect():
        assert abs(r["s"] - 1.0) < 1e-9
    path = str(tmp_path / "m")
    tm.model.write().overwrite().save(path)
    again = PipelineModel(stages=SC._classifier_stages(PipelineModel.load(path))).transform(b)
    a = {r["item_id"]: r["predictedLabel"] for r in out.collect()}
    c = {r["item_id"]: r["predictedLabel"] for r in again.collect()}
    assert a == c


def above_majority(per):
    rows = per.collect()
    n = sum(r["n_label"] for r in rows)
    return sum(r["tp"] for r in rows) > max(r["n_label"] for r in rows), n


def test_training_beats_majority(spark):
    for name, train in (("domain-lr", M.train_domain()), ("domain-ovr", M.train_domain("ovr_lr"))):
        assert above_majority(M.evaluate_domain(spark, SF0001, name, train))[0], name


def test_perceptron_fits_its_training_rows(spark):
    per = M.perceptron_statistics(spark, SF0001)
    assert above_majority(per)[0]
    assert per.filter("tp + fp > 0").count() > 1  # more than one class is predicted


def test_task_model_does_not_see_the_label(spark):
    """The domain is not a function of the role, so held-out turns are not all right by leakage."""
    t = S.turns(spark, SF0001)
    assert t.groupBy("domain").agg(F.countDistinct("strLabel").alias("n")).filter("n > 1").count() >= 2
    rows = M.evaluate_task(spark, SF0001).collect()
    assert sum(r["tp"] for r in rows) <= sum(r["n_label"] for r in rows)


def test_task_model_with_a_label_only_in_held_out_rows(spark):
    from parlance.operators import train as TR
    rows = [(i, ["a", "b"][i % 2], "na" if i % 3 else "x", [i % 2 / 1.0, 0.5], True) for i in range(20)]
    rows += [(100, "c", "new", [0.1, 0.2], False)]
    df = spark.createDataFrame(rows, "id int, strLabel string, previousTask string, classifierFeatures array<double>, "
                                     "is_train boolean")
    m = TR.train_task_model(df.filter("is_train"), df)
    assert m.transform(TR.task_input(df)).count() == 21
    assert set(TR.model_labels(m)) == {"a", "b", "c"}


def test_model_one_hot_is_the_operators(spark):
    """The encoder of the task model gives q_one_hot's vectors."""
    from parlance.plans.context_jobs import q_one_hot
    m = M.task_model(spark, SF0001)
    t = S.turn_labels(spark, SF0001)
    encode = PipelineModel(stages=[m.stages[1], m.stages[3], m.stages[4]])
    model = {(r["conv_id"], r["turn"]): r["taskEncoded"].toArray().tolist() for r in encode.transform(t).collect()}
    table = {(r["conv_id"], r["turn"]): [float(x) for x in r["task_encoded"].split(",")] for r in
             q_one_hot(spark, SF0001).collect()}
    assert model == table
    unseen = encode.transform(spark.createDataFrame([("never",)], "previousTask string")).first()
    assert not unseen["taskEncoded"].toArray().any()


def test_store(spark, tmp_path):
    from parlance.operators import store as ST
    models = M.intent_models(spark, SF0001)
    root = str(tmp_path / "store")
    assert ST.registry(spark, root) is None
    ST.save_models(spark, [models], root)
    again = ST.load_linear(spark, root)
    assert list(zip(again.domains, again.classifiers)) == sorted(zip(models.domains, models.classifiers))
    assert set(ST.load_linear(spark, root, domain="nba").domains) == {"nba"}
    assert ST.load_models(spark, root, kind="task") == []


def test_hash_split_ignores_partitioning(spark):
    docs = S.documents(spark, SF0001, ("doc_id",))
    a = {r["doc_id"]: r["is_train"] for r in SP.hash_split(docs, "doc_id").collect()}
    b = {r["doc_id"]: r["is_train"] for r in SP.hash_split(docs.repartition(7), "doc_id").collect()}
    assert a == b and 0.6 < sum(a.values()) / len(a) < 0.95


def test_global_prior_equals_single_window(spark):
    t = S.turns(spark, SF0001)
    ours = CX.domain_prior(t, ["conv_id", "turn"], num_ranges=5)
    w = Window.orderBy("conv_id", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("domain").isin("nba", "weather")
    ref = t.select("conv_id", "turn", F.when(known, F.sum(F.when(F.col("domain") == "nba", 1).otherwise(0)).over(w)
                                               / F.sum(known.cast("int")).over(w)).otherwise(0.5).alias("p0"))
    a = {(r["conv_id"], r["turn"]): r["prior"][0] for r in ours.collect()}
    b = {(r["conv_id"], r["turn"]): r["p0"] for r in ref.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_blocked_windows_equal_plain_windows(spark):
    """Conversations cut into blocks of 1-3 turns give the plain-window results."""
    t = S.turns(spark, SF0001)
    wc = Window.partitionBy("conv_id").orderBy("turn")
    plain_prev = {(r["conv_id"], r["turn"]): r["p"] for r in
                  t.select("conv_id", "turn", F.coalesce(F.lag("strLabel").over(wc), F.lit("na")).alias("p")).collect()}
    run = wc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("domain").isin("nba", "weather")
    plain_prior = {(r["conv_id"], r["turn"]): r["p0"] for r in t.select(
        "conv_id", "turn", F.when(known, F.sum(F.when(F.col("domain") == "nba", 1).otherwise(0)).over(run)
                                  / F.sum(known.cast("int")).over(run)).otherwise(0.5).alias("p0")).collect()}
    for block in (1, 2, 3):
        prev = CX.previous_task(t, ["conv_id"], ["turn"], "strLabel", block=block)
        assert {(r["conv_id"], r["turn"]): r["previousTask"] for r in prev.collect()} == plain_prev
        pri = CX.domain_prior(t, ["turn"], partition_cols=["conv_id"], block=block)
        got = {(r["conv_id"], r["turn"]): r["prior"][0] for r in pri.collect()}
        assert got.keys() == plain_prior.keys()
        assert all(abs(got[k] - plain_prior[k]) < 1e-12 for k in got)
        glob = CX.domain_prior(t, ["conv_id", "turn"], num_ranges=3, block=block)
        assert glob.count() == t.count()


def test_classify_all_respects_requested_domain(spark):
    models = M.intent_models(spark, SF0001)
    b = M.slot_text(spark, M.benchmark_texts(spark, SF0001)).withColumn(
        "domain", F.when(F.col("item_id") % 2 == 0, F.lit("nba")))
    out = SC.classify_all(b, models, "item_id", M.TEXT_FOR, domain_col="domain")
    for r in out.collect():
        if r["item_id"] % 2 == 0:
            assert r["domain"] == "nba"


def test_lr_join_scoring_equals_transform(spark):
    a = {(r["item_id"], r["classifier"]): r["score"] for r in M.multi_classify(spark, SF0001).collect()}
    b = {(r["item_id"], r["classifier"]): r["score"] for r in M.multi_classify_join(spark, SF0001).collect()}
    assert a.keys() == b.keys() and len(a) > 0
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9
