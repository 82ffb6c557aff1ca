"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set if more than half of the 64-bit hashes of the
text's word shingles have it.  Equal fingerprints are collapsed first.  A
fingerprint is cut into two segments of 32 bits; two fingerprints that differ
in at most three bits differ in at most one bit of some segment.  Each
distinct fingerprint is in the table under both segments, and probes it with
the segments' Hamming balls of radius one (of two segments that differ in one
bit, one has the bit set, so only set bits need clearing).  What meets under a
segment value is verified by the distance of the whole fingerprints.

Within a segment value only a spanning forest of the verified links leaves the
task, never all pairs; a value met by very many distinct fingerprints is cut
into blocks, and every pair of blocks is a group of its own, so no group is
unbounded and no link is lost.  Components are found by joins on the forest's
edges.

Cases: a null text counts as empty; texts without words have fingerprint zero
and are linked like any others; fewer words than a shingle make one shingle;
repeated rows get the same component; a null document id is never a component
id unless the component has no other; more columns, whatever their names, are
kept by ``one_of_each`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import join_by_key, quoted, stored

BITS = 64
SEGMENT = 32
BLOCK = 2000  # distinct fingerprints of one segment value that are compared in one group


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text as a signed 64-bit number."""
    import xxhash

    words = text.encode().lower().split()  # A-Z only; the white space of the word rule
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    width = min(shingle, len(words))
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    votes = np.zeros(BITS, "i8")
    for at in range(0, n, 1 << 14):
        stop = min(n, at + (1 << 14))
        h = np.array([digest(joined[s:e], seed) for s, e in
                      zip(starts[at:stop], ends[at + width - 1:stop + width - 1], strict=True)], "<u8")
        votes += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """doc_id, fp and text_hash of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(v.as_py(), shingle, seed) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())],
                                             ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _segment(fp: Column, which: int) -> Column:
    """Segment value with the segment's number above it."""
    value = F.shiftrightunsigned(fp, SEGMENT) if which else fp.bitwiseAND((1 << SEGMENT) - 1)
    return value + F.lit(which << SEGMENT)


def forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """(fingerprint, least of its component) for all but the least, by distance within these."""
    rest = np.unique(fps).view("u8")  # bits of signed numbers would be counted in their absolute values
    nodes, roots = [], []
    while len(rest):
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= distance
            if near.any():
                found = rest[near]
                queue += list(found)
                nodes += found.view("i8").tolist()
                roots += [int(root.astype("i8"))] * len(found)
                rest = rest[~near]
    return nodes, roots


def block_pairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Groups (key, i, j, fps) of ``rows`` (key, fp): every pair of blocks of a key's fingerprints, keys of one left out.

    The groups are dealt by all three columns: an aggregation would be content
    with rows that a join had dealt by key, and put a key's groups into one task.
    """
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    heavy = max(block, rows.count() // 1000)
    sized = join_by_key(rows, sizes, "key", heavy, "n").where("n is not null")
    return (sized.select("key", "fp", mine.alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
            .select("key", "fp", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
            .repartition("key", "i", "j").groupBy("key", "i", "j").agg(F.collect_list("fp").alias("fps")))


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (src, dst) whose components are those of "at most ``distance`` (up to 3) bits apart"."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius one find distances up to 3")
    fp = F.col("fp")
    table = distinct.select("fp", F.explode(F.array(_segment(fp, 0), _segment(fp, 1))).alias("key"))
    cleared = [F.when(F.shiftright(fp, b).bitwiseAND(1) == 1, _segment(fp, b // SEGMENT) - F.lit(1 << b % SEGMENT))
               for b in range(BITS)]
    probes = (distinct.select("fp", F.explode(F.array(*cleared)).alias("key")).where(F.col("key").isNotNull()))
    keys = table.groupBy("key").agg(F.count("*").alias("n"))
    met = stored(probes.join(keys.select("key").hint("shuffle_hash"), "key", "left_semi"), "probes")
    linked = met.select("key").union(keys.where("n > 1").select("key")).distinct()
    rows = table.join(linked, "key", "left_semi").select("key", "fp").union(met.select("key", "fp"))
    rows = stored(rows, "buckets")
    dealt = block_pairs(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src: list[int] = []
            dst: list[int] = []
            for fps in batch.column(0):
                a, b = forest(fps.values.to_numpy(), distance)
                src += a
                dst += b
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return dealt.select("fps").mapInArrow(run, "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root being its component's least node.

    Each round joins every node's neighbours to the least of them, then
    replaces a parent by its own; the rounds grow with the logarithm of a
    component's diameter.  Each round is written to the shared folder.
    """
    edges = stored(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
                   .where("src != dst").distinct(), "edges")
    while True:
        least = edges.groupBy("src").agg(F.min("dst").alias("p"))
        star = (edges.join(least, "src").where("dst != p").select(F.col("dst").alias("src"), F.col("p").alias("dst"))
                .union(least.select("src", F.col("p").alias("dst"))).distinct())
        star = stored(star, "star")
        of = star.groupBy("dst").agg(F.count("*").alias("w"))
        parent = star.groupBy(F.col("src").alias("dst")).agg(F.min("dst").alias("p")).join(of, "dst")
        jumped = join_by_key(star, parent, "dst", max(1, star.count() // 1000), "w")
        edges = stored(jumped.select("src", F.coalesce("p", "dst").alias("dst")).distinct(), "edges")
        if not parent.take(1) and not (
                star.groupBy("src").count().where("count > 1").take(1)):
            return star.select(F.col("src").alias("node"), F.col("dst").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, seed: int = 42, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, component_id, keeper of every row.

    ``keeper`` is (id is null, id, text hash) of the component's row that
    stays when one does: least id, then least hash.
    """
    rows = stored(fingerprints(docs, shingle, seed, doc_id, text), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    distinct = stored(rows.groupBy("fp").agg(F.count("*").alias("rows"), first.alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), distance))
    rooted = (distinct.join(roots, distinct["fp"] == roots["node"], "left")
              .select("fp", "rows", "first", F.coalesce("root", "fp").alias("root")))
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("keeper"), F.count("*").alias("fps"))
    heavy = max(1, rows.count() // 1000)
    of_fp = stored(join_by_key(rooted, least, "root", heavy, "fps").select("fp", "rows", "keeper"), "components")
    out = join_by_key(rows, of_fp, "fp", heavy, "rows")
    return out.select("doc_id", "text_hash", "fp", F.col("keeper.doc_id").alias("component_id"), "keeper")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """The documents without all but one of each component, columns as given.

    Kept rows are found by (id, text hash), so texts move once; repeated rows
    of a kept document (rare) are dropped to one.
    """
    marked = near_duplicates(docs, shingle, distance, seed)
    mine = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    kept = (marked.where(mine == F.col("keeper")).groupBy("doc_id", "text_hash")
            .agg(F.count("*").alias("_n")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "_n"))
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_doc")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("_d"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_t"))
    found = rows.join(kept, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_h")))
    single = found.where("_n = 1").select("_doc.*")
    repeated = found.where("_n > 1").dropDuplicates(["_d", "_t"]).select("_doc.*")
    return single.unionByName(repeated)
