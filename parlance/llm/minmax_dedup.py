"""MinHash near-duplicates by min-max hashing.

A document's set holds the 64-bit hashes of its distinct word shingles.  Under
each of ``PERMUTATIONS`` random permutations both the least and the greatest
element are kept, so a signature has twice as many values as hash evaluations;
each value agrees with the Jaccard similarity as its probability, and minimum
and maximum of one permutation vary against each other, so the estimate has
less variance than one from as many minima of few permutations.  Bands are cut
from minima only or maxima only: the two of one permutation never share a band.

Equal sets are collapsed first.  Sets that agree in a band meet in a bucket.
A bucket's pairs are never all made: in star rounds every set of a bucket is
compared with one representative, unless both are already in one component;
the verified links make components, which close most buckets.  In buckets that
still hold several components, signatures find the sets of different components
that may be similar; these are joined to clusters, and within a cluster every
such pair is compared, by blocks, so no group is unbounded and nothing is
capped.  A pair is compared only if its signatures agree in enough values, and
every comparison counts the whole sets' intersection.

Whole sets are hashed again, only for texts that are compared: a bitmap of
fixed size tells which (bitmaps.py), so sets of all documents are never stored.

A pair exactly at the threshold of 0.85 is missed by all 32 bands of 5 values
with probability (1 - 0.85 ** 5) ** 32, under 1e-8; the agreement asked of
signatures lies six standard deviations below the threshold.

Cases: a text without words, empty or null has an empty set, is linked with
nothing and is its own component; fewer words than a shingle make one shingle;
repeated rows share a component; a null document id is a component's id only
if it has no other, and such a row is kept only then; an empty table gives no
rows; more columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.bitmaps import BITS, bitmap, marked
from parlance.llm.common import join_by_key, stored
from parlance.llm.simhash import components

PERMUTATIONS = 80
ROWS = 5  # values in a band
BANDS = 2 * PERMUTATIONS // ROWS
CHUNK = 1 << 21  # characters of text hashed at once
BLOCK = 500  # sets of a bucket or cluster compared in one group
BYTES = 16 << 20  # bytes of sets in a block
PAIRS_A_ROW = 1000  # star rounds go on while the buckets left open hold more pairs than this a row
PAIRS = 200  # pairs that share one copy of a set


@dataclass(frozen=True)
class MinMaxParams:
    """Shingle words, similarity threshold in percent, seed, most star rounds, bits of the bitmap of compared texts."""

    shingle: int = 5
    percent: int = 85
    seed: int = 11
    rounds: int = 3
    bits: int = BITS

    @property
    def agree(self) -> int:
        """Signature values that must agree: six standard deviations below the threshold."""
        p, n = self.percent / 100, 2 * PERMUTATIONS
        return int(n * p - 6 * (n * p * (1 - p)) ** 0.5)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    import xxhash

    words = text.encode().lower().split()  # A-Z only; the white space of the word rule
    if not words:
        return np.empty(0, "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, "u8")
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k:k + n]
    return np.unique(_mixed(out))


def signatures(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """(sets, 2 * PERMUTATIONS) low 16 bits of minima, then of maxima; the sets are not empty."""
    draw = np.random.default_rng(seed)
    factors = draw.integers(0, 1 << 63, PERMUTATIONS, "u8") << np.uint64(1) | np.uint64(1)
    shifts = draw.integers(0, (1 << 64) - 1, PERMUTATIONS, "u8", endpoint=True)
    every = np.concatenate(sets)
    begins = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), 2 * PERMUTATIONS), "<u2")
    for i in range(PERMUTATIONS):
        x = every * factors[i] + shifts[i]  # an odd factor permutes the 64-bit numbers
        out[:, i] = np.minimum.reduceat(x, begins) & np.uint64(0xFFFF)
        out[:, PERMUTATIONS + i] = np.maximum.reduceat(x, begins) & np.uint64(0xFFFF)
    return out


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of at most CHUNK bytes of text, or one longer text."""
    sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
    begun, size = 0, 0
    for i, w in enumerate(sizes.tolist()):
        if size and size + w > CHUNK:
            yield begun, i
            begun, size = i, 0
        size += w
    if begun < len(sizes):
        yield begun, len(sizes)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = F.col(f"`{doc_id}`").cast("long")
    return docs.select(d.alias("doc_id"), F.xxhash64(d, t).alias("place"), t.alias("_text"))


def signed(docs: DataFrame, params: MinMaxParams = MinMaxParams(), doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """doc_id, place (hash of id and text), n_shingles, sid (128-bit digest of the set) and sig of every row.

    ``sid`` and ``sig`` are null for an empty set.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            for begun, end in _parts(batch.column(2)):
                part = batch.slice(begun, end - begun)
                sets = [shingle_set(t.as_py(), params.shingle) for t in part.column(2)]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full, params.seed) if full else ())
                sids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sigs = [next(sig).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(sids, pa.binary()), pa.array(sigs, pa.binary())],
                    ["doc_id", "place", "n_shingles", "sid", "sig"])

    return _texts(docs, doc_id, text).mapInArrow(
        run, "doc_id long, place long, n_shingles long, sid binary, sig binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, params: MinMaxParams, doc_id: str, text: str) -> DataFrame:
    """(id, items): whole sets of ``wanted`` (id, sid, place), hashed from the texts again."""
    places = wanted.sparkSession.sparkContext.broadcast(bitmap(wanted, F.col("place"), params.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        seen: set = set()  # places of this task whose set is out; 8 bytes for each wanted one
        for batch in batches:
            place = batch.column(1).to_numpy()
            hit = np.flatnonzero(marked(places.value, place))
            hit = [i for i in hit.tolist() if place[i] not in seen]
            for at in range(0, len(hit), 100):
                sids, items = [], []
                for i in hit[at:at + 100]:
                    if place[i] not in seen:
                        seen.add(place[i])
                        s = shingle_set(batch.column(2)[i].as_py(), params.shingle)
                        sids.append(xxhash.xxh3_128_digest(s.tobytes()))
                        items.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(items, pa.binary())],
                                                 ["sid", "items"])

    found = _texts(docs, doc_id, text).mapInArrow(run, "sid binary, items binary")
    return found.join(wanted.select("id", "sid"), "sid").dropDuplicates(["id"]).select("id", "items")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two whole sets (sorted) are as similar as asked."""
    a, b = (x, y) if len(x) <= len(y) else (y, x)
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _agreeing(pairs: DataFrame, distinct: DataFrame, params: MinMaxParams) -> DataFrame:
    """The ``pairs`` (a, b) whose signatures agree in enough values."""
    total = pairs.count()

    def with_sig(left: DataFrame, side: str) -> DataFrame:
        need = pairs.groupBy(side).agg(F.count("*").alias("_n"))
        right = need.join(distinct.select(F.col("id").alias(side), F.col("sig").alias(f"{side}_sig")), side)
        return join_by_key(left, right, side, max(PAIRS, total // 1000), "_n").drop("_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in (2, 3))
            out = batch.filter(pa.array((x == y).sum(1) >= params.agree))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], ["a", "b"])

    both = with_sig(with_sig(pairs, "a"), "b")
    return both.select("a", "b", "a_sig", "b_sig").mapInArrow(run, "a long, b long")


def compared(pairs: DataFrame, sets: DataFrame, distinct: DataFrame, params: MinMaxParams) -> DataFrame:
    """The ``pairs`` (a, b) whose whole sets are as similar as asked, as edges (src, dst).

    Pairs whose signatures differ too much are dropped first.  A set goes to
    its pairs by a shuffled join; one that many pairs need is copied once for
    every PAIRS of them, so no key is hot.
    """
    pairs = stored(_agreeing(pairs, distinct, params), "agreeing")
    total = pairs.count()
    copies = {side: pairs.groupBy(side).agg(F.count("*").alias("_n")) for side in "ab"}
    dealt = pairs
    for side, need in copies.items():
        dealt = join_by_key(dealt, need, side, max(PAIRS, total // 1000), "_n").withColumn(
            f"{side}_copy", F.pmod(F.xxhash64("a", "b"), F.ceil(F.col("_n") / PAIRS))).drop("_n")
    dealt = stored(dealt, "dealt")
    for side, need in copies.items():
        many = need.select(F.col(side).alias("id"), (F.ceil(F.col("_n") / PAIRS) - 1).alias("last"))
        copied = sets.join(many, "id").select(F.col("id").alias(side), F.col("items").alias(f"{side}_items"),
                                              F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias(f"{side}_copy"))
        dealt = dealt.join(copied, [side, f"{side}_copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), params.percent)
                    for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], ["src", "dst"])

    return dealt.select("a", "b", "a_items", "b_items").mapInArrow(run, "src long, dst long")


def _fit(percent: int, n: Column, m: Column) -> Column:
    """Whether sets of these sizes can be as similar as asked."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def block_pairs(members: DataFrame, key: str, blocks: Column, columns: tuple[str, ...]) -> DataFrame:
    """Groups (i, j, group) of ``members``: every pair of the blocks that a key's members are dealt to.

    The groups are dealt by (key, i, j): an aggregation would be content with
    rows that a join had dealt by key, and put a key's groups into one task.
    """
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = members.select(key, F.struct(*columns, mine.alias("b")).alias("s"), mine.alias("b"),
                           F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)).alias("o"))
    return (dealt.select(key, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "s")
            .repartition(key, "i", "j").groupBy(key, "i", "j").agg(F.collect_list("s").alias("group"))
            .select("i", "j", "group"))


def _possible(n: np.ndarray, root: np.ndarray, block: np.ndarray, sig: np.ndarray, x: int, i: int, j: int,
              params: MinMaxParams) -> np.ndarray:
    """Members of block j, of other components than x's, that may be as similar as asked."""
    near = (root != root[x]) & (block == j) & (100 * np.minimum(n, n[x]) >= params.percent * np.maximum(n, n[x]))
    if i == j:
        near[:x + 1] = False
    at = np.flatnonzero(near)
    return at[(sig[at] == sig[x]).sum(1) >= params.agree]


def _members(group: pa.Scalar, *columns: str) -> list[np.ndarray]:
    rows = group.values
    sig = np.frombuffer(b"".join(rows.field("sig").to_pylist()), "<u2").reshape(len(rows), -1)
    return [*(rows.field(c).to_numpy() for c in ("id", "n", "root", "b")), sig, *(rows.field(c) for c in columns)]


def possible_links(members: DataFrame, params: MinMaxParams) -> DataFrame:
    """Edges (src, dst) that join all ``members`` (key, id, n, root, sig, m) of a key and of different components that may
    be similar: a forest per group, never all pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids, n, root, block, sig = _members(group)
                tree = np.arange(len(ids))  # trees of the forest so far
                src, dst = [], []
                for x in np.flatnonzero(block == i):
                    at = _possible(n, root, block, sig, x, i, j, params)
                    for y in at[np.unique(tree[at], return_index=True)[1]]:
                        if tree[y] != tree[x]:
                            src.append(int(ids[x]))
                            dst.append(int(ids[y]))
                            tree[tree == tree[y]] = tree[x]
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    groups = block_pairs(members, "key", F.ceil(F.col("m") / BLOCK), ("id", "n", "root", "sig"))
    return groups.mapInArrow(run, "src long, dst long").distinct()


def links_within(clusters: DataFrame, sets: DataFrame, params: MinMaxParams) -> DataFrame:
    """Links (src, dst) between components among ``clusters`` (cluster, id, n, root, sig): a forest per group.

    A cluster goes to one group, or by blocks of BLOCK sets or BYTES to a group per pair of blocks.
    """
    size = clusters.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(8 * F.col("n")) / BYTES)).alias("blocks"), F.count("*").alias("m"))
    held = join_by_key(clusters, size, "cluster", max(BLOCK, clusters.count() // 1000), "m").join(sets, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids, n, root, block, sig, items = _members(group, "items")
                sets = [np.frombuffer(x.as_buffer(), "<u8") for x in items]
                root = root.copy()
                src, dst = [], []
                for x in np.flatnonzero(block == i):
                    for y in _possible(n, root, block, sig, x, i, j, params):
                        if root[y] != root[x] and _similar(sets[x], sets[y], params.percent):
                            src.append(int(ids[x]))
                            dst.append(int(ids[y]))
                            root[root == root[y]] = root[x]
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    groups = block_pairs(held, "cluster", F.col("blocks"), ("id", "n", "root", "sig", "items"))
    return groups.mapInArrow(run, "src long, dst long")


def _keys(sig: np.ndarray) -> np.ndarray:
    """(sets, BANDS) bucket keys of (sets, values) signatures."""
    out = np.empty((len(sig), BANDS), "u8")
    for b in range(BANDS):
        key = np.full(len(sig), b, "u8")
        for value in sig[:, b * ROWS:(b + 1) * ROWS].T:
            key = (key + value) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        out[:, b] = key
    return out.view("i8")


def shared_buckets(distinct: DataFrame, params: MinMaxParams) -> DataFrame:
    """(key, id, n) of the buckets in which several sets of ``distinct`` (id, n, sig) meet.

    Keys are counted first; a bitmap of those that come twice keeps the rows of all others from the second shuffle.
    """
    rows = distinct.select("id", "n", "sig")

    def run(marks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = _keys(np.frombuffer(b"".join(part.column(2).to_pylist()), "<u2").reshape(part.num_rows, -1))
                if marks is None:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel())], ["key"])
                    continue
                row, band = np.nonzero(marked(marks.value, keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys[row, band]), part.column(0).take(pa.array(row)),
                                                  part.column(1).take(pa.array(row))], ["key", "id", "n"])

    counted = rows.mapInArrow(lambda b: run(None, b), "key long").groupBy("key").agg(F.count("*").alias("m"))
    shared = stored(counted.where("m > 1"), "shared")
    marks = distinct.sparkSession.sparkContext.broadcast(bitmap(shared, F.col("key"), params.bits))
    found = rows.mapInArrow(lambda b: run(marks, b), "key long, id long, n long")
    heavy = max(1, shared.agg(F.sum("m")).first()[0] or 0) // 1000 + 1
    return join_by_key(found, shared, "key", heavy, "m").where("m is not null").drop("m")


def set_components(docs: DataFrame, distinct: DataFrame, params: MinMaxParams, doc_id: str, text: str) -> DataFrame:
    """(node, root) of the sets of ``distinct`` (id, sid, n, sig, place) that are linked with others."""
    spark = docs.sparkSession
    met = stored(shared_buckets(distinct, params), "met")
    rows = met.count()
    heavy = max(1, rows // 1000)
    members = met.select("id").distinct()
    sets = stored(whole_sets(docs, distinct.join(members, "id", "left_semi"), params, doc_id, text), "sets")
    none = spark.createDataFrame([], "src long, dst long")
    roots = none.select(F.col("src").alias("node"), F.col("dst").alias("root"))

    def still_open(turn: int) -> tuple[DataFrame, int]:
        """Rows (key, id, n, root, m, rep) of the keys that hold several components, and the number of pairs in these keys."""
        placed = met.join(roots, met["id"] == roots["node"], "left").select(
            "key", "id", "n", F.coalesce("root", "id").alias("root"))
        placed = stored(placed, "placed")
        order = F.xxhash64("id", "key", F.lit(turn)) if turn else F.col("id")
        per = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"),
                                        F.min(F.struct(order.alias("o"), "id", "n", "root")).alias("rep"))
        per = stored(per.where("low < high").select("key", "m", "rep"), "open")
        pairs = per.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0] or 0
        return join_by_key(placed, per, "key", heavy, "m").where("m is not null"), pairs

    def joined(found: DataFrame) -> DataFrame:
        """The components with these links, too."""
        if not found.limit(1).count():
            return roots
        return components(roots.select(F.col("node").alias("src"), F.col("root").alias("dst")).union(found))

    several, pairs = still_open(0)
    turn = 0
    while pairs and turn < params.rounds and (not turn or pairs > PAIRS_A_ROW * rows):
        star = several.where((F.col("root") != F.col("rep.root")) & _fit(params.percent, F.col("n"), F.col("rep.n")))
        star = stored(star.select(F.least("id", "rep.id").alias("a"), F.greatest("id", "rep.id").alias("b")).distinct(), "pairs")
        roots = joined(stored(compared(star, sets, distinct, params), "links"))
        turn += 1
        several, pairs = still_open(turn)
    if not pairs:
        return roots
    rest = several.select("key", "id", "n", "root", "m").join(distinct.select("id", "sig"), "id")
    edges = stored(possible_links(rest, params), "possible")
    if not edges.limit(1).count():
        return roots
    clusters = components(edges).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    clusters = clusters.union(clusters.select("cluster", "cluster").distinct())  # the least member of each, too
    whole = clusters.join(distinct.select("id", "n", "sig"), "id").join(
        roots.select(F.col("node").alias("id"), F.col("root").alias("_root")), "id", "left").withColumn(
        "root", F.coalesce("_root", "id")).drop("_root")
    return joined(stored(links_within(stored(whole, "clusters"), sets, params), "links"))


def near_duplicates(docs: DataFrame, params: MinMaxParams = MinMaxParams(), doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least document id of the component), kept of every row."""
    rows = stored(signed(docs, params, doc_id, text), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place"))
    distinct = (rows.where("sid is not null").groupBy("sid")
                .agg(F.count("*").alias("rows"), first.alias("first"), F.first("n_shingles").alias("n"),
                     F.first("sig").alias("sig")))  # equal sets have equal signatures
    distinct = stored(distinct.select(F.monotonically_increasing_id().alias("id"), "*",
                                      F.col("first.place").alias("place")), "distinct")
    roots = set_components(docs, distinct, params, doc_id, text)
    of_set = distinct.join(roots, distinct["id"] == roots["node"], "left").select(
        "sid", "rows", "first", F.coalesce("root", "id").alias("root"))
    of_set = stored(of_set, "rooted")
    least = of_set.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("sets"))
    heavy = max(1, rows.count() // 1000)
    named = stored(join_by_key(of_set, least, "root", heavy, "sets").select("sid", "rows", "least"), "named")
    out = join_by_key(rows.drop("sig"), named, "sid", heavy, "rows")
    mine = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return out.select("doc_id", "n_shingles", mine.alias("component_id"), F.col("doc_id").eqNullSafe(mine).alias("kept"))
