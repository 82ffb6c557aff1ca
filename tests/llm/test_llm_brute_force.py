"""Query results against independent brute force on the small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parlance.llm import queries as Q

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name, sf_dir=SF):
    return Q.JOBS[name](spark, sf_dir).collect()


def test_quality_base(spark, docs):
    rows = run(spark, "op1_quality_rules")
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]["text"] or ""
        words = WORD.findall(text)
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        count = Counter(windows)
        hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
                len(hit), failed)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                r["base_failed"]) == want
        assert not (failed and r["kept"])


def test_quality_keeps_clean_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = [r for r in run(spark, "op1_quality_rules", SF01) if not r["base_failed"]]
    assert all(r["kept"] for r in rows if labels.get(r["doc_id"]) == 1)
    assert sum(not r["kept"] for r in rows if labels.get(r["doc_id"]) == 0) >= 5


def test_js_distance_by_hand(spark):
    from pyspark.sql import functions as F

    from parlance.llm.quality import js_distance
    df = spark.range(1).select(F.array(F.lit(3), F.lit(1)).alias("c"), F.lit(4).alias("n"))
    got = df.select(js_distance(F.col("c"), F.col("n"), [0.25, 0.75]).alias("d")).first()["d"]
    p, q = np.array([0.75, 0.25]), np.array([0.25, 0.75])
    m = (p + q) / 2
    assert math.isclose(got, math.sqrt(((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2))


def test_shards(spark, docs):
    rows = run(spark, "op2_balanced_shards", SF01)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(16)) and len(rows) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    shard, groups = {r["doc_id"]: r["shard"] for r in rows}, defaultdict(list)
    for d, t in texts.items():
        groups[t].append(shard[d])
    cut = sum(len(set(g)) > 1 for g in groups.values())
    assert cut <= 0.05 * sum(len(g) > 1 for g in groups.values())


def test_shards_with_a_hot_group(spark, tables):
    text = lambda i: "hot" if i % 3 == 0 else f"pair {i // 6}" if i % 6 < 3 else f"own {i}"
    got = run(spark, "op2_balanced_shards", tables(docs=[(i, text(i), "en", "a", 1) for i in range(3000)]))
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 3000 and max(sizes.values()) - min(sizes.values()) <= 1
    of_text = defaultdict(set)
    for r in got:
        of_text[text(r["doc_id"])].add(r["shard"])
    hot = Counter(r["shard"] for r in got if r["doc_id"] % 3 == 0)
    assert sum(n for _, n in hot.most_common(8)) >= 950  # 1000 of 3000 rows need at least 6 of 16 shards
    cut = sum(len(s) > 1 for t, s in of_text.items() if t.startswith("pair"))
    assert cut <= 50  # of 500 pairs


def test_no_block_of_a_hot_group_is_large(spark):
    """A third of all rows equal: every (shard, block, part) that is numbered in one task stays near block_rows."""
    from parlance.llm import sharding as S
    nodes = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(5).cast("long").alias("size"),
                                       F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("text_crc32"),
                                       F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("hub"))
    out = S.balanced_shards(nodes, shards=4, rounds=2, block_rows=500)
    largest = out.groupBy("shard", "alone", "block", "part").count().agg(F.max("count")).first()[0]
    assert largest <= 4 * 500
    assert sorted(r["n"] for r in out.groupBy("shard").agg(F.count("*").alias("n")).collect()) == [15_000] * 4


def test_flows_leave_no_shard_above_its_quota():
    from parlance.llm.sharding import balanced_flows
    flow = balanced_flows([[0, 10, 0], [10, 0, 5], [0, 0, 0]], [0, 0, 3])
    for t in range(3):
        assert sum(flow[s][t] for s in range(3)) - sum(flow[t]) <= [0, 0, 3][t] + 1e-4
    assert flow[0][1] > 6 and flow[1][0] > 6  # the exchange goes through


def test_mix(spark):
    rows = run(spark, "op3_mix_sources", SF01)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    size, source_of = {}, {}
    for d, r in docs.items():
        size[d], source_of[d] = len(WORD.findall(r["text"] or "")), r["source"]
    total = Counter()
    for d, s in source_of.items():
        total[s] += size[d]
    names = sorted(total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, budget = set(), 1.5 * sum(total.values())
    while True:  # the excess is shared again by weight until none is above its limit
        free = budget - sum(2 * total[s] for s in full)
        unit = free / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and unit * weight[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * total[s] if s in full else unit * weight[s] for s in names}
    taken = Counter()
    for r in rows:
        s = source_of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s])
        assert math.isclose(r["target"], target[s], rel_tol=1e-9)
        assert r["taken"] in {k * r["size"] for k in (math.floor(r["rate"]), math.floor(r["rate"]) + 1)}
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in names:  # within five standard deviations of independent draws
        f = target[s] / total[s] % 1
        sd = math.sqrt(sum(size[d] ** 2 for d in size if source_of[d] == s) * f * (1 - f))
        assert abs(taken[s] - target[s]) <= 5 * sd + 1
    again = {r["doc_id"]: r["taken"] for r in run(spark, "op3_mix_sources", SF01)}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


@pytest.mark.parametrize("shape", ["null ids", "one id", "equal rows"])
def test_mix_of_rows_that_share_ids(spark, tables, shape):
    """Each row draws for itself, so taken words come near the target."""
    ids = {"null ids": lambda i: None, "one id": lambda i: 5, "equal rows": lambda i: None}[shape]
    text = (lambda i: "one two") if shape == "equal rows" else (lambda i: f"w{i} two")
    docs = [(ids(i), text(i), "en", "ab"[i % 3 == 0], 1) for i in range(3000)]
    got = run(spark, "op3_mix_sources", tables(docs=docs))
    taken, target = Counter(), {}
    for r in got:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert len(got) == 3000 and all(abs(taken[s] - t) < 0.06 * t for s, t in target.items())


def test_mix_without_broadcasts_equals_mix_with(spark, tables, monkeypatch):
    """The way for very many sources and shared ids: salted joins give the same rows."""
    from parlance.llm import mixing
    docs = [(None if i % 5 == 0 else i, f"w{i % 7} two three", "en", f"s{i % 3}" if i % 4 else None, 1) for i in range(400)]
    sf_dir = tables(docs=docs)
    both = []
    for few in (10_000, 0):
        monkeypatch.setattr(mixing.few, "__defaults__", (few,))
        df = spark.read.parquet(f"{sf_dir}/documents.parquet")
        small = mixing.sized(df)
        kept = mixing.with_copies(small, small.drop("place"), salt_rows=50, weights=(5, 2, 1), share=1.5, limit=2.0)
        both.append(sorted(map(str, kept.select("doc_id", "source", "text_hash", "place", "copies", "rate").collect())))
    assert both[0] == both[1] and len(both[0]) == 400


def test_secrets(spark, docs):
    assign = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                        r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in run(spark, "op4_secret_scan"):
        text, spans = docs[r["doc_id"]]["text"] or "", []
        spans += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        names = ("assign", "access", "hex")
        base = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_random_strings():
    from parlance.llm import secrets as S
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        count = S._counter(f.read(), public_tokenizers.PATTERN)
    found = lambda t: [t[s:e] for s, _, e in S.random_spans(t, count, S.SecretRules())]
    assert found("key ghp_x7Kq9Lm2Zt4Rv8Wb1Nc5Yd3Pf6 end") == ["ghp_x7Kq9Lm2Zt4Rv8Wb1Nc5Yd3Pf6"]
    for harmless in ("some_identifier_name_2024", "getUserByIdAndName2", "2024-01-02T03:04:05.123456",
                     "9c3e1c9e-1111-4222-8333-123456789abc", "path/to/file/number12", "Foo-Bar-Baz-12345678",
                     hashlib.sha256(b"x").hexdigest(), "1234567890123456789012345", "a" * 5000 + "1" + "b" * 5000):
        assert found(harmless) == [], harmless


def random_finder(**rules):
    from parlance.llm import secrets as S
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        count = S._counter(f.read(), public_tokenizers.PATTERN)
    return lambda t: [t[s:e] for s, _, e in S.random_spans(t, count, S.SecretRules(**rules))]


def test_random_strings_of_both_cases():
    found = random_finder()
    for secret in ("qWzRtYpLkJhGfDsAzXcVbNmQ", "QWZRTYPLKJhgfdsazxcvbnmqw", "xQ/vBzKj+WqTnPfGhLdRsMyC=="):
        assert found(f"key {secret} end") == [secret]
    for harmless in ("AbstractSingletonProxyFactoryBean", "XMLHttpRequestFactoryBean", "Foo-Bar-Baz-Qux-Quux-Corge",
                     "THIS_IS_A_LONG_CONSTANT_NAME", "/Users/JohnSmith/Documents/Projects"):
        assert found(harmless) == [], harmless
    assert found("qWzRtYpLkJhGfDsAzXQ") == []  # 19 characters
    assert random_finder(min_length=12)("key qX7zRt9LkJh2 end") == ["qX7zRt9LkJh2"]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
def test_random_strings_of_one_case(letters):
    """Runs of one case and no digit are judged by their tokens, too; long words and short parts are none."""
    found, rng = random_finder(), np.random.default_rng(0)
    for length in (24, 32):
        runs = ["".join(rng.choice(list(letters), length)) for _ in range(300)]
        assert sum(found(f"key {r} end") == [r] for r in runs) >= 299
    for harmless in ("Donaudampfschifffahrtsgesellschaft", "antidisestablishmentarianism", "INTERNATIONALIZATIONSETTINGS",
                     "incomprehensibilities", "a" * 60, "word-" * 12 + "end", "some_identifier_name_of_many_words"):
        assert found(harmless) == [], harmless


def test_random_strings_beside_numbers_and_uuids():
    found, uuid = random_finder(), "9c3e1c9e-1111-4222-8333-123456789abc"
    for secret in ("407408718192-a8kd93hfk20dkf93jdkslq02kfmv", "123456789012-Xk93jfKd02mfLq81PzRt",
                   "1-Xk93jfKd02mfLq81PzRt", "v2-a8kd93hfk20dkf93jdkslq02kfmv", f"{uuid}_Xk93jfKd02mfLq81PzRtQw",
                   f"Xk93jfKd02mfLq81PzRtQw-{uuid}", f"Xk93jfKd02mf{uuid}Lq81PzRtQw"):
        assert found(f"key {secret} end") == [secret]
    for harmless in (uuid, uuid.upper(), f"request-{uuid}", f"{uuid}/{uuid}", f"trace_{uuid}-retry-2",
                     "2024-01-02T03-04-05Z", "2024-01-02T030405-backup3", "3-beta4-SNAPSHOT-20240102",
                     "20240102-123456-g2414721", "v12-14-rc2-linux-amd64", "1-2nd-3rd-4th-5th-6th"):
        assert found(harmless) == [], harmless


def simhash_truth(texts):
    import xxhash
    fp = {}
    for d, text in texts.items():
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        shingles = ([" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2
                    else [" ".join(words)] if words else [])
        votes = Counter()
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            votes.update(b for b in range(64) if h >> b & 1)
        fp[d] = sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))
    root = {d: d for d in fp}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{fp[d]:016x}", find(d)) for d in ids}


def test_simhash(spark, docs):
    want = simhash_truth({d: r["text"] for d, r in docs.items()})
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op5_simhash_near_dedup")}
    assert got == want


def test_block_pairs_are_dealt_by_key_and_blocks(spark):
    from parlance.llm import simhash as S
    rows = spark.range(900).select(F.pmod(F.col("id"), F.lit(3)).alias("key"), F.col("id").alias("fp"))
    out = S.block_pairs(rows, block=100)
    assert re.search(r"hashpartitioning\(key#\d+L?, i#\d+, j#\d+", out._jdf.queryExecution().executedPlan().toString())
    groups = out.collect()
    assert len(groups) == 3 * 6 and max(len(r["fps"]) for r in groups) < 250  # three blocks a key, in pairs
    met = {(a, b) for r in groups for a in r["fps"] for b in r["fps"]}
    assert len(met) == 3 * 300 * 300


def test_simhash_links_of_dense_groups(spark, monkeypatch):
    """Chains and dense balls, with blocks so small that every value is cut."""
    from parlance.llm import simhash
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = np.random.default_rng(5)
    fps = set()
    for c in rng.integers(0, 1 << 63, 12).tolist():
        fps.add(c)
        for _ in range(40):
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False).tolist():
                c ^= 1 << b
            fps.add(c)
    fps = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    assert {f: got.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_neighbours_over_several_shards(spark, tables):
    """Recall over many shards, with ids that several vectors share: each of them is a candidate."""
    from parlance.llm import graph_search as G
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 24))
    vectors = [(i % 2900, [float(np.float32(x)) for x in centre[i % 40] + 0.4 * rng.normal(size=24)], 0) for i in range(3000)]
    df = G.valid_vectors(spark.read.parquet(tables(vectors=vectors) + "/embeddings.parquet"))
    p = G.GraphParams(shard_rows=400)
    asked = df.where(F.col("vec_id").isin(list(range(100, 2900, 50))))  # ids of one vector
    got = defaultdict(list)
    for r in G.nearest(df, asked, 10, p).collect():
        got[r["query_id"]].append((round(r["score"], 9), r["vec_id"]))
    x, ids = np.array([v for _, v, _ in vectors], "f4").astype("f8"), np.array([i for i, *_ in vectors])
    hits = total = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        on = ids != q
        want = sorted(zip(np.round(d[on], 9).tolist(), ids[on].tolist(), strict=True))[:10]
        assert len(found) == 10
        hits += len(set(want) & set(found))
        total += 10
    assert len(got) == 56 and hits >= 0.9 * total


def test_neighbours_copy_no_index_for_the_queries(spark, tables, monkeypatch):
    """Any number of queries: each shard is built once and no graph is stored or shuffled."""
    from parlance.llm import graph_search as G
    rng = np.random.default_rng(5)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], 0) for i in range(900)]
    df = G.valid_vectors(spark.read.parquet(tables(vectors=vectors) + "/embeddings.parquet"))
    names = []
    monkeypatch.setattr(G, "stored", lambda d, name, f=G.stored: names.append(name) or f(d, name))
    out = G.nearest(df, df, 5, G.GraphParams(shard_rows=300, query_block=64))
    assert "binary" not in str(out._jdf.queryExecution().analyzed().toString()).lower() and names == ["dims"]
    got = {(r["query_id"], r["rank"]): (round(r["score"], 9), r["vec_id"]) for r in out.collect()}
    x = np.array([v for _, v, _ in vectors], "f4").astype("f8")
    want = {}
    for q in range(900):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = sorted((round(float(d[i]), 9), i) for i in range(900) if i != q)[:5]
        want |= {(q, r + 1): b for r, b in enumerate(best)}
    assert got.keys() == want.keys() and sum(got[k] == want[k] for k in want) >= 0.9 * len(want)


def test_neighbours_with_a_shared_id(spark, tables):
    rows = [(0, [0.0, 1.0], 0), (7, [0.0, 5.0], 0), (7, [0.0, 1.1], 0), (7, [0.0, 1.1], 0), (8, [3.0, 1.0], 0)]
    got = run(spark, "op6_graph_neighbours", tables(vectors=rows))
    assert [(r["vec_id"], round(r["score"], 5)) for r in sorted(got, key=lambda r: r["rank"])] == [(7, 0.1), (8, 3.0), (7, 4.0)]


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF01}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], "f8")
    got = defaultdict(list)
    for r in sorted(run(spark, "op6_graph_neighbours", SF01), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    hit = total = 0
    for q in ids[ids % 100 == 0].tolist():
        score = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [ids[i] for i in np.lexsort((ids, score)) if ids[i] != q][:10]
        hit, total = hit + len(set(best) & set(got[q])), total + 10
    assert hit / total >= 0.9


def test_bpe(spark, docs):
    import base64

    import tiktoken
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in run(spark, "op7_byte_bpe"):
        text = docs[r["doc_id"]]["text"] or ""
        ids = reference.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_random_texts():
    import random

    import tiktoken

    from parlance.llm import bpe
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        encoder, decoder = bpe.worker_encoder(f.read(), public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(1)
    signs = "ab  \n\t'sé漢🙂  \x1c\x85.,1٣ǅ́\0 the"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t in [*texts, "a" * 20_000, " " * 20_001, "abcde" * 9000, "é" * 5000]:
        ids = encoder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), t[:50]
        assert decoder.decode(ids) == t.encode()


def test_bpe_ranks_in_any_order():
    """Vocabularies where a merge makes a pair of lower rank, so that others of its bucket must wait."""
    import random

    import tiktoken

    from parlance.llm import bpe
    rng = random.Random(5)
    for _ in range(30):
        longer = list({"".join(rng.choices("ab ", k=rng.randint(2, 6))).encode() for _ in range(60)})
        rng.shuffle(longer)
        ranks = {t: i for i, t in enumerate([*(bytes([b]) for b in range(256)), *longer])}
        reference = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
        pieces = ["".join(rng.choices("ab ", k=rng.randint(1, 60))) for _ in range(100)] + ["a" * 3000, "ab " * 700]
        pieces = [p for p in pieces if p.encode() not in ranks]
        found = bpe.Merger(ranks).merge([p.encode() for p in pieces])
        assert [np.frombuffer(i, "<u4").tolist() for i in found] == [reference.encode_ordinary(p) for p in pieces]


def test_bpe_merges_new_words_together(monkeypatch):
    """The new words of a group of texts go through few queues, not one each; long ones are not kept."""
    import random

    from parlance.llm import bpe
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.load_ranks(f.read())
    encoder = bpe.ChunkIds(ranks, public_tokenizers.PATTERN, limit=500)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("etaoinshr", k=12)) for _ in range(50)) for _ in range(200)]
    texts += ["x" * 500 + "1" * 500, "x" * 5000, ""]
    queues, merge = [], encoder.merger.merge
    monkeypatch.setattr(encoder.merger, "merge", lambda pieces: queues.append(len(pieces)) or merge(pieces))
    together = encoder.encode_all(texts)
    size = sum(len(t) for t in texts)
    assert sum(queues) > 9000 and len(queues) <= size // bpe._QUEUE_BYTES + 1
    assert max(map(len, encoder)) <= encoder.longest
    assert together == [encoder.encode(t) for t in texts]  # over several generations
    assert max(map(len, [*encoder, *encoder.old])) <= encoder.longest


def accuracy(rows, truth):
    held = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert held
    return held


def test_language(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = run(spark, "op8_language_id", SF01)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = accuracy(rows, truth)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_language_features_by_hand():
    from parlance.llm import langid as G
    p = G.LangParams(buckets=64)
    data = "Äb cab".lower().encode()
    want = Counter()
    for n in p.orders:
        for i in range(len(data) - n + 1):
            h = n
            for b in data[i:i + n]:
                h = (h * 0x01000193 + b) % (1 << 32)
            want[(h * 0x9E3779B1) % (1 << 32) >> 26] += 1
    at, share = G.features("Äb cab", p)
    total = sum(want.values())
    assert dict(zip(at.tolist(), (share * total).round().astype(int).tolist(), strict=True)) == dict(want)
    long = "".join(chr(97 + i * i % 26) for i in range(600_000))  # cut in pieces: no n-gram lost or counted twice
    assert sum(len(h) for h in G.ngram_buckets(long, p)) == sum(len(long) - n + 1 for n in p.orders)


def test_language_training_against_dense_steps():
    """The same steps on dense matrices, with the gradient found by differences."""
    from parlance.llm import langid as G
    p = G.LangParams(buckets=8, dim=3, epochs=2, rate=0.5)
    rng = np.random.default_rng(0)
    sample = [("ab"[i % 2], np.sort(rng.choice(8, 3, False)).astype("i4"), np.array([0.5, 0.25, 0.25], "f4")) for i in range(15)]
    got = G.train(sample, p)
    rng = np.random.default_rng(p.seed)
    order = rng.permutation(15)
    learn = order[3:]
    embed, to_lang, bias = rng.normal(0, 1 / 3, (8, 3)), np.zeros((3, 2)), np.zeros(2)

    def loss(e, m, b, x, y):
        z = x @ e @ m + b
        return -(z[y] - np.log(np.exp(z).sum()))

    steps = 0
    for _ in range(2):
        for i in rng.permutation(learn):
            lang, at, share = sample[i]
            x = np.zeros(8)
            x[at] = share
            rate = 0.5 * (1 - steps / (2 * len(learn)))
            steps += 1
            slopes = []
            for which in range(3):
                parts = [embed, to_lang, bias]
                slope = np.zeros_like(parts[which])
                for k in np.ndindex(slope.shape):
                    for sign in (1, -1):
                        moved = [q.copy() for q in parts]
                        moved[which][k] += sign * 1e-5
                        slope[k] += sign * loss(*moved, x, "ab".index(lang)) / 2e-5
                slopes.append(slope)
            embed -= rate * len(at) ** 0.5 * slopes[0]  # embeddings' steps grow with the number of features
            to_lang -= rate * slopes[1]
            bias -= rate * slopes[2]
    assert np.abs(got.table - embed @ to_lang).max() < 1e-4 and np.abs(got.bias - bias).max() < 1e-5


def test_trees_against_all_splits():
    """A stump is the best of all splits between the bins; boosting lowers the loss from tree to tree."""
    from parlance.llm import toxicity as X
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3)).round(1)
    y = ((x[:, 1] + 0.3 * rng.normal(size=80)) > 0.2).astype(float)
    p = X.ToxicityParams(trees=1, depth=1, bins=8, min_leaf=3)
    base, ((((feature, threshold),), leaves),) = X.fit_trees(x, y, p)
    prob = y.mean()
    grad, hess = y - prob, np.full(80, prob * (1 - prob))
    best = (0, None)
    for f in range(3):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 9)[1:-1])):
            left = x[:, f] <= cut
            if 3 <= left.sum() <= 77:
                gain = sum(grad[s].sum() ** 2 / (hess[s].sum() + 1) for s in (left, ~left))
                if gain > best[0] + 1e-9:
                    best = (gain, (f, cut, left))
    f, cut, left = best[1]
    assert (feature[0], threshold[0]) == (f, cut) and math.isclose(base, math.log(prob / (1 - prob)))
    for leaf, s in zip(leaves, (left, ~left), strict=True):
        assert math.isclose(leaf, p.rate * grad[s].sum() / (hess[s].sum() + 1))

    def loss(n):
        z = X.tree_scores(x, X.fit_trees(x, y, X.ToxicityParams(trees=n, depth=2, bins=8, min_leaf=3)))
        return (np.logaddexp(0, z) - y * z).sum()

    losses = [loss(n) for n in (1, 5, 20)]
    assert losses == sorted(losses, reverse=True)


def test_isotonic_against_the_minimax_form():
    from parlance.llm import toxicity as X
    rng = np.random.default_rng(2)
    for n in (1, 2, 30):
        score, y = rng.integers(0, 12, n).astype(float), rng.integers(0, 2, n).astype(float)
        knots, values = X.fit_isotonic(score, y)
        mean = lambda a, b: y[(score >= a) & (score <= b)].mean()
        want = [max(min(mean(a, b) for b in knots if b >= k) for a in knots if a <= k) for k in knots]
        assert np.allclose(values, want) and (np.diff(values) >= -1e-12).all()


def test_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = run(spark, "op9_toxicity", sf_dir)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = accuracy(rows, truth)
    toxic, clean = ([r for r in held if truth[r["doc_id"]] == k] for k in (1, 0))
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = {r["doc_id"]: r for r in run(spark, "op10_simple8b_tokens")}, 0
    for d in sorted(docs):
        ids = [*tokenizer.encode(docs[d]["text"] or "", add_special_tokens=False).ids, 2]
        r = got[d]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (
            start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_texts_with_an_added_token(spark, tables):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["plain words", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext |>",
             "<|endoftext|> plain words " * 500, "plain words <|endoftext"]
    got = {r["doc_id"]: r for r in run(spark, "op10_simple8b_tokens", tables(
        docs=[(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]))}
    start = 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (
            start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_ids_of_cut_texts_against_the_library():
    """Any white space, marks and long words, also where the tables of words are emptied again and again."""
    import pyarrow as pa
    from parlance.llm import simple8b
    from tokenizers import Tokenizer
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        data = f.read()
    tokenizer, rng, end = Tokenizer.from_str(data), random.Random(5), b"\2\0\0\0"
    plain = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\v", "\f", "\n ", "\t ", "a", "bc", "word", "Wörter", "été", "é,", "×,",
             "÷.", "º!", "don't", "'s", "''s", "'re,", "x'sy", "...", ",", "$", "#@", "1", "23", "4,5", "٣", "漢字", "漢,字", "🙂,",
             "á,", "’s", "—", "\x01", "\x7f", "\u200b", "ß" * 20, "supercalifragilistic" * 2, "Donaudampf" * 8]
    odd = ["\xa0", "\u202f", "\u3000", "\x85", "\x1c", "\0", "<|endoftext|>", "<|endoftext"]
    small = simple8b.LibraryIds(data, public_tokenizers.PATTERN, limit=50, words=100)
    large = simple8b.LibraryIds(data, public_tokenizers.PATTERN)
    for _ in range(300):
        texts = ["".join(rng.choices(rng.choice([plain, plain, plain + odd]), k=rng.choice([0, 1, 2, 3, 8, 60])))
                 for _ in range(rng.choice([1, 2, 12]))]
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + end for t in texts]
        column = pa.array(["before", *texts, "behind"]).slice(1, len(texts))
        assert small.encode(column, end) == want and large.encode(column, end) == want


def test_words_go_to_the_library_once():
    """A word before different marks is one word; it stays known however many others come (up to the bound)."""
    import pyarrow as pa
    from parlance.llm import simple8b
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        library = simple8b.LibraryIds(f.read(), public_tokenizers.PATTERN, limit=10)
    given, learn = [], library.learn
    library.learn = lambda new: given.extend(new) or learn(new)
    for k in range(40):
        library.encode(pa.array([f"so many words, words. words; n{chr(97 + k % 26)}w{chr(97 + k // 26)} été, été!"]), b"")
    assert len(given) == len(set(given)) == 8 + 40  # so, many, words, été, the four marks; the others


def test_simple8b_round_trip():
    from parlance.llm import simple8b
    rng = np.random.default_rng(0)
    for k in range(60):
        n = int(rng.integers(0, 5000))
        widths = rng.integers(0, 65 if k % 3 else 17, n)
        ids = np.array([int(rng.integers(0, (1 << int(w)) - 1, dtype=np.uint64, endpoint=True)) for w in widths], "u8")
        words, n_words, n_escapes = simple8b.encode_blocks(np.sort(ids) if k % 5 == 0 else ids)
        assert (simple8b.decode_blocks(words, n_words, n_escapes) == (np.sort(ids) if k % 5 == 0 else ids)).all()


def test_pipeline_against_its_stages(spark):
    """The pipeline's documents are those that the single checks, by brute force, leave."""
    import corpus_pipeline
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in run(spark, "op1_quality_rules") if r["kept"]}
    groups = simhash_truth({d: texts[d]["text"] for d in kept})
    kept = {d for d in kept if groups[d][1] == d}
    rows = corpus_pipeline.run(spark, SF).collect()
    copies = Counter(r["doc_id"] for r in rows)
    assert set(copies) <= kept and max(copies.values()) <= 2
    assert len(copies) >= 0.7 * len(kept)  # the mix leaves out documents of over-long sources only
    assert len({(r["doc_id"], r["ids_sha256"]) for r in rows}) == len(copies)
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
