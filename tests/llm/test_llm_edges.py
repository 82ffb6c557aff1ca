"""Every query on awkward rows: nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import math

import pytest

import corpus_pipeline
from edge_docs import EDGE_DOCS
from parlance.llm import queries as Q

LABELS = [(3, 1, 0), (4, 0, 1), (5, 1, 0), (6, None, None), (7, 0, 1), (None, 1, 1)]
VECTORS = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (100, None, 0), (200, [0.0, 0.0], 0), (300, [1.0, None], 0),
           (400, [float("nan"), 1.0], 0), (500, [1.0, 1.0], 0), (501, [1.0, 1.0], 0), (7, [1.0, 1.0], 0),
           (None, [1.0, 2.0], 0), (600, [1.0, 2.0, 3.0], 0), (700, [], 0), (9, [float("inf"), 1.0], 0)]
DOC_QUERIES = [n for n in Q.JOBS if not n.startswith(("op6_", "op12_", "op13_"))]  # vectors; phrases


@pytest.mark.parametrize("name", DOC_QUERIES)
def test_awkward_rows(spark, tables, name):
    """With more columns, of names that operators use; without them in test_query_results_of_awkward_rows."""
    rows = Q.JOBS[name](spark, tables(labels=LABELS, extra=True)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d[0]) for d in EDGE_DOCS)


@pytest.mark.parametrize("name", list(Q.JOBS))
def test_empty_tables(spark, tables, name):
    df = Q.JOBS[name](spark, tables(docs=[]))
    assert df.collect() == [] and df.columns


def test_neighbours_of_awkward_vectors(spark, tables):
    rows = Q.JOBS["op6_graph_neighbours"](spark, tables(vectors=VECTORS, extra=True)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
    assert got == {0: [(7, 1.0), (500, 1.0), (501, 1.0)], 500: [(7, 0.0), (501, 0.0), (0, 1.0)]}


def test_pipeline_on_awkward_rows(spark, tables):
    sf_dir = tables(extra=True)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, sf_dir).count() >= 0
    # stages after the first on all awkward rows
    redacted = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret_scan(spark, docs, sf_dir).collect()}
    assert redacted[7] == "[SECRET]\" [SECRET] 漢字🙂 été" and redacted[0] is None and redacted[1] == ""
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, sf_dir).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(3) == 1 and 4 not in ids and ids.count(None) == 1
    assert [i for i in ids if i in (0, 1, 2)] == [0]  # texts without words are one group
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    assert corpus_pipeline.byte_bpe(spark, docs, sf_dir).count() == len(EDGE_DOCS)


def test_pipeline_on_empty_table(spark, tables):
    assert corpus_pipeline.run(spark, tables(docs=[])).collect() == []


def test_query_results_of_awkward_rows(spark, tables):
    sf_dir = tables(labels=LABELS)
    by = lambda n: {r["doc_id"]: r for r in Q.JOBS[n](spark, sf_dir).collect()}
    quality = by("op1_quality_rules")
    assert quality[0]["n_words"] == quality[1]["n_words"] == quality[2]["n_words"] == 0
    assert quality[5]["n_words"] == 30_000 and quality[5]["base_failed"]  # every window comes again
    mix = by("op3_mix_sources")
    assert all(r["taken"] <= 2 * r["size"] for r in mix.values()) and mix[0]["size"] == 0
    language = by("op8_language_id")
    assert language[0]["lang_pred"] == language[8]["lang_pred"] == "und" and language[0]["score"] == 0.0
    toxic = by("op9_toxicity")
    assert all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in toxic.values())
    tokens = Q.JOBS["op10_simple8b_tokens"](spark, sf_dir).collect()
    assert sum(r["n_tokens"] for r in tokens if r["doc_id"] in (0, 1)) == 2  # only the end id


def test_clusters_of_awkward_vectors(spark, tables):
    wide = [(i, None if v is None else (v * 64)[:64], n) for i, v, n in VECTORS]
    rows = Q.JOBS["op12_bitplane_clusters"](spark, tables(vectors=wide, extra=True)).collect()
    assert sorted(str(r["vec_id"]) for r in rows) == ["0", "0", "200", "500", "501", "600", "7", "None"]
    assert {r["distance"] for r in rows} == {0}  # fewer different vectors than clusters
