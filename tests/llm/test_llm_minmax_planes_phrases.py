"""Min-max near-duplicates, bit-plane clusters and phrase collocations against brute force, and on awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_docs import EDGE_DOCS
from parlance.llm import bitmaps, bitplanes, collocations, minmax_dedup
from parlance.llm import queries as Q


# ---------------------------------------------------------------- near-duplicates by min-max hashing
def brute_components(docs, percent=85, width=5):
    sets = []
    for _, text, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)})
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(docs):
        least[find(i)].append(d[0])
    ids = {r: min((x for x in v if x is not None), default=None) for r, v in least.items()}
    return sorted(((str(d[0]), len(sets[i]), ids[find(i)] if sets[i] else d[0]) for i, d in enumerate(docs)), key=repr)


def rows_of(spark, sf_dir):
    got = Q.JOBS["op11_minmax_near_dedup"](spark, sf_dir).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got), key=repr)


def near_docs():
    """Chains around the threshold, copies in other case, a large group of near copies without their original."""
    rng = np.random.default_rng(5)
    docs, n = [], 0
    words = [f"w{i}" for i in range(4000)]
    for _ in range(25):
        base = list(rng.choice(words, 60 + int(rng.integers(0, 80))))
        docs.append((n, " ".join(base), "en", "a", 1))
        n += 1
        for step in range(1, 6):  # ever more words changed
            other = base[:]
            for k in range(step):
                other[7 + 9 * k] = "changed"
            docs.append((n, "  ".join(other).upper() + "\n", "en", "a", 1))
            n += 1
    base = list(rng.choice(words, 100))
    for i in range(120):  # one word changed each: pairs lie at the threshold, depending on the place
        other = base[:]
        other[int(rng.integers(0, 100))] = f"own{i}"
        docs.append((n + i, " ".join(other), "en", "a", 1))
    return docs


def test_minmax_equals_brute_force(spark, tables):
    docs = near_docs() + [(None, "a b", "en", "a", 1), (None, "A  b", "en", "a", 1), (9000, "a b c", "en", "a", 1)]
    assert rows_of(spark, tables(docs=docs)) == brute_components(docs)


def test_minmax_block_pairs_equal_brute_force(spark, tables, monkeypatch):
    """Buckets cut into many blocks, and no star rounds: every link comes from the last step."""
    monkeypatch.setattr(minmax_dedup, "BLOCK", 7)
    docs = near_docs()
    df = spark.read.parquet(tables(docs=docs) + "/documents.parquet")
    got = minmax_dedup.near_duplicates(df, minmax_dedup.MinMaxParams(rounds=0)).collect()
    assert sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_components(docs)


def test_minmax_of_awkward_rows(spark, tables):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in
           Q.JOBS["op11_minmax_near_dedup"](spark, tables()).collect()}
    assert {(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (4, 2, 3, False)} <= got
    assert (None, 1, None, True) in got and (6, 1, 6, True) in got


def test_signatures_estimate_similarity():
    """Minimum and maximum agree as often as the similarity says, and vary less than independent minima would."""
    rng = np.random.default_rng(0)
    wins, sums = [], 0.0
    for _ in range(600):
        every = rng.integers(0, 1 << 63, 100, "u8")
        a, b = minmax_dedup.signatures([np.unique(every[:80]), np.unique(every[20:])], int(rng.integers(1 << 30)))
        wins.append((a == b).mean())
        sums += wins[-1]
    assert abs(sums / 600 - 0.6) < 0.01
    assert np.std(wins) < 1.1 * math.sqrt(0.6 * 0.4 / 160)


def test_group_of_block_pairs_is_dealt_by_its_columns(spark):
    """An exchange on (key, i, j) lies between the join of sizes and the groups."""
    rows = spark.range(50).select(F.pmod(F.col("id"), F.lit(3)).alias("key"), F.col("id"), F.lit(9).cast("long").alias("m"))
    plan = minmax_dedup.block_pairs(rows, "key", F.col("m"), ("id",))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(key#\d+L?, i#\d+L?, j#\d+L?", plan)


def test_bitmap(spark):
    keys = [0, 1, -1, 1 << 62, -(1 << 63), 99]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    bits = bitmaps.bitmap(df, F.col("k"), 1 << 16)
    assert bitmaps.marked(bits, np.array(keys)).all()
    assert not bitmaps.marked(bits, np.array([2, 3, 100, -2])).any()
    assert not bitmaps.bitmap(df.limit(0), F.col("k"), 1 << 16).any()


# ---------------------------------------------------------------- clusters over bit planes
def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()))[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[0]].append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else old
                     for c, old in enumerate(centroids)]
    final = [(i, *nearest(v)) for i, v in kept]
    per = Counter()
    for _, c, d in final:
        per[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, per[c], sum(per.values()), digest[c]) for i, c, d in final)


def test_clusters_equal_brute_force(spark, tables):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(i % 5 - 2, 1 + i % 3, 64)]) for i in range(300)]
    rows += [(1000, None), (1001, [1.0] * 63), (1002, [None] + [1.0] * 63), (1003, [math.nan] + [1.0] * 63),
             (1004, [math.inf] + [1.0] * 63), (1005, []), (1006, [0.0] * 64), (1007, [0.0] * 64), (7, rows[7][1])]
    got = Q.JOBS["op12_bitplane_clusters"](spark, tables(vectors=[(*r, 0) for r in rows])).collect()
    assert sorted(map(tuple, got)) == brute_clusters(rows)


def test_clusters_of_few_and_of_large_vectors(spark, tables):
    rows = [(1, [3.0e6] * 64), (2, [-3.0e6, 1.0] * 32), (3, [2.5e6] * 64)]
    got = Q.JOBS["op12_bitplane_clusters"](spark, tables(vectors=[(*r, 0) for r in rows])).collect()
    assert sorted(map(tuple, got)) == brute_clusters(rows)


def test_clusters_of_huge_vectors_have_null_distances(spark, tables):
    """Beyond 64 bits the assignment is still exact; what no long can hold is null."""
    rows = [(i, [1e30 * (1 + (i + j) % 3) for j in range(64)]) for i in range(12)]
    got = Q.JOBS["op12_bitplane_clusters"](spark, tables(vectors=[(*r, 0) for r in rows])).collect()
    want = brute_clusters(rows)
    assert [(r["vec_id"], r["cluster"]) for r in sorted(got, key=lambda r: r["vec_id"])] == [w[:2] for w in want]
    assert all(r["distance"] == (w[2] if w[2] < 1 << 63 else None)
               for r, w in zip(sorted(got, key=lambda r: r["vec_id"]), want, strict=True))


@pytest.mark.parametrize("high", [3, 1 << 11, 1 << 26, 1 << 40, 1 << 90])
def test_planes_round_trip_and_dot(high):
    rng = np.random.default_rng(2)
    x = np.array([[int(rng.integers(-3, 3)) * (high // 2) + int(rng.integers(-1, 2)) for _ in range(64)] for _ in range(9)], object)
    planes = bitplanes.planes_needed(x)
    words = bitplanes.to_planes(x, planes)
    assert (bitplanes.from_planes(words) == x).all()
    for c in range(9):
        assert bitplanes.dots(words, words[c]).tolist() == [int((a * x[c]).sum()) for a in x]


# ---------------------------------------------------------------- phrase collocations
def brute_phrases(docs, least=10, top=2000):
    f, n, out = Counter(), Counter(), []
    for _, text, lang, *_ in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3):
                f.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    ranked = defaultdict(list)
    for (lang, p), a in candidates.items():
        hidden = any(l2 == lang and len(q) > len(p) and 2 * b >= a and any(q[i:i + len(p)] == p for i in range(len(q)))
                     for (l2, q), b in candidates.items())
        if not hidden:
            score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                                        for k in range(1, len(p)))
            ranked[lang].append((-score, -a, " ".join(p).encode(), left, right))
    for lang, rows in ranked.items():
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_docs():
    rng = np.random.default_rng(3)
    words = ["new", "york", "city", "the", "of", "Été", "漢字", "a-b", "x", "zz"]
    docs = [(i, "".join(str(rng.choice(words)) + str(rng.choice([" ", "  ", "\t", ". ", ", ", "\n", " ", " "]))
                        for _ in range(60)), [None, "en", "und", "fr"][i % 4], "a", 1) for i in range(60)]
    docs += [(100 + i, "New York City of the", "en", "a", 1) for i in range(40)] + [(100, "New York City", "en", "a", 1)]
    return docs


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_phrases_equal_brute_force(spark, tables):
    docs = phrase_docs()
    got = Q.JOBS["op13_phrase_collocations"](spark, tables(docs=docs)).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute_phrases(docs)


@pytest.mark.parametrize("params", [
    dict(fingerprint_bits=5),  # hardly any fingerprint is of one phrase only
    dict(chunk=64, held=50),  # texts are cut, and tasks let their counts go all the time
    dict(bits=1 << 15),
])
def test_phrases_do_not_depend_on_hashes_or_sizes(spark, tables, params):
    docs = phrase_docs()
    df = spark.read.parquet(tables(docs=docs) + "/documents.parquet")
    got = collocations.collocations(df, collocations.PhraseParams(**params)).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute_phrases(docs)


def test_phrases_of_awkward_rows(spark, tables):
    got = Q.JOBS["op13_phrase_collocations"](spark, tables(extra=True)).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute_phrases(EDGE_DOCS)


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql.functions import col
    rows = [(999999999999999, 999999999999999, 10 ** 15), (123456789012345, 923456789012345, 987654321098765)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = [r["s"] for r in df.select(collocations._score(col("a"), col("l"), col("r")).alias("s")).collect()]
    assert got == [1000000 * a * a // (x * y) for a, x, y in rows]


def test_cut_parts_count_every_word_once():
    data = b"one two, three  four five six. seven"
    for size in (1, 5, 9, 100):
        parts = collocations.cut(data, size, 3)
        assert b"".join(data[b:e] for b, e, _ in parts) == data
        assert all(e <= s for _, e, s in parts)
