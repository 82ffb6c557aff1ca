"""Hashed bigram vectors of whole blocks of texts: those of the saved pipelines' stages; lines are cut once."""

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import linear as LN
from parlance.operators import train as TR
from parlance.operators import vectors as V
from parlance.plans import models as M
from parlance.sources import lines as L

TEXTS = ["", " ", None, "a", "a b", " a  b ", "A\tB\nc\x0bd\fe\rf", "Straße Ärger  ÉCOLE x y", "日本 語 テキスト 😀 x", "\n\n",
         "x " * 3000, "a" * 5000 + " b c", "a b a b", "  lead", "trail  \t\n", "İstanbul ΑΣ ΑΣ b", "a\x00b c"]


def test_block_vectors_are_those_of_the_stages(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, utterance string").coalesce(1)
    for width in (5000, 7):
        want = PipelineModel(stages=TR.text_feature_stages("utterance", width)).transform(df)
        want = {r["i"]: r["features"] for r in want.select("i", "features").collect()}
        got = TR.featurize_text(df, "utterance", width)
        assert got.columns == ["i", "utterance", "features"]
        assert {r["i"]: r["features"] for r in got.collect()} == want


def test_blocks_of_any_size_give_the_same_counts(monkeypatch):
    low = pa.array([t and t.lower() for t in TEXTS], pa.string())
    whole = V.counts(low, 5000)
    monkeypatch.setattr(V, "_BYTES", 1)
    for a, b in zip(whole, V.counts(low, 5000), strict=True):
        assert np.array_equal(a, b)
    assert np.array_equal(V.counts(low.slice(5), 5000)[2], whole[2][whole[0][5]:])
    assert V.counts(low.slice(0, 0), 5000)[0].tolist() == [0]


def test_no_vocabulary_is_looked_up_for_frames(spark):
    """Training rows and scored texts do not go through strings of buckets."""
    df = spark.createDataFrame([("a b c",)], "utterance string")
    plan = TR.featurize_text(df, "utterance", 100)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "UDF" not in plan


def test_lines_are_cut_once_for_a_filter(spark):
    """The filter on the number of fields does not cut the line again below the projection."""
    df = spark.createDataFrame([(1, "a b\tx"), (2, "alone"), (3, None), (4, "\t\t"), (5, " c \t y \t")], "line_id int, value string")
    out = L.parse_utterances(df, min_fields=2, keep=("line_id",))
    assert sorted(map(tuple, out.collect())) == [(1, "a b", "x"), (5, "c", "y")]
    assert out._jdf.queryExecution().executedPlan().toString().count("EndsWith(value") <= 2


def test_trim_and_fields_equal_their_patterns(spark):
    rows = ["", None, "\t\t", "a\tb\t", "a\t\tb", "\ta", " x ", "\x00 x\x1f", "é x\t é ", "a,b,,", " ", " x ", "x\n"]
    c, df = F.col("v"), spark.createDataFrame([(x,) for x in rows], "v string")
    got = df.select("v", T.java_trim(c).alias("t"), T.split_fields(c).alias("f"), T.split_fields(c, ",").alias("g")).collect()

    def fields(x, sep):
        return None if x is None else [""] if x == "" else [] if x.strip(sep) == "" else x.rstrip(sep).split(sep)

    for r in got:
        x = r["v"]
        assert r["t"] == (None if x is None else x.strip("".join(map(chr, range(33)))))
        assert r["f"] == fields(x, "\t") and r["g"] == fields(x, ",")


def test_unlabelled_documents_are_dropped_before_their_texts_are_cut(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "en"), (2, "c d", "de"), (3, "e f", "en"), (4, None, "en")], "doc_id long, text string, lang string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r["line_id"], r["utterance"], r["strLabel"]) for r in M.intent_rows(spark, str(tmp_path)).collect())
    assert got == [(1, "a b", "Other"), (1, "a b", "quality")]
    assert M.S.intent_lines(spark, str(tmp_path), labelled=True).count() == 3


def test_a_pass_computes_only_the_models_of_each_run_of_rows(spark, monkeypatch):
    from tests.test_linear import toy
    rows, keys = toy(spark).coalesce(1), LN.Keys(("a", "b", "a"), ("x", "x", "y"), "Other")
    packed = LN.pack(rows, keys)
    (block,) = packed.blocks.collect()
    assert block["places"] == "<u2" and block["kind"] == "u1"
    batches = pa.Table.from_pylist([block.asDict()]).to_batches()
    runs = list(LN._batches(iter(batches), packed.apart))
    assert sum(len(r[3]) for r in runs) == rows.count() and len(runs) == 2 * 4
    assert all(len(set(r[3].tolist())) == 1 and len(set(r[4].tolist())) == 1 for r in runs)
    assert sum(r[2].sum() for r in runs) == sum(v["features"].values.sum() for v in rows.collect())
