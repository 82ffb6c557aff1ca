"""Centroid clustering over bit planes.

A vector of 64 whole-number components is kept as its bit planes: plane p is
one unsigned 64-bit word that holds bit p of every component (two's
complement, so the last plane weighs negative).  The dot product of a vector
and a centroid is the sum, over all pairs of their planes, of the planes'
weights times the number of ones in the AND of the two words; with the squared
lengths it gives the squared distance, in whole numbers throughout.

Vectors are made into planes once and written.  Every round is one pass over
that table: a task assigns its vectors and sums them per cluster, the sums are
added by Spark, and only a number per centroid and component reaches the
driver.  A round that leaves all centroids as they were ends the rounds, since
all later ones would, too.

As many planes are used as the largest component needs; where products could
pass 64 bits, the same steps run on Python's whole numbers.

Cases: vectors that are null, not of 64 components, or hold a null or
non-finite one take no part; with fewer vectors than clusters there are as
many clusters as vectors; equal vectors are rows of their own; a null id is
hashed last; of rows with equal ids the one with the lesser planes comes
first; a distance or sum beyond a long is null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import stored

SIZE = 64
NARROW = 28  # with at most so many planes all arithmetic fits 64 bits
PIECE = 8192  # vectors worked on at once
LIMB = 40  # bits of a component's sum in one shuffled number


def planes_needed(components: np.ndarray) -> int:
    """Planes of the two's complement of all components."""
    if not components.size:
        return 1
    low, high = int(components.min()), int(components.max())
    return max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers: 64-bit where they fit, else Python's."""
    with np.errstate(over="ignore"):
        x = np.floor(values * float(scale))
    if np.abs(x, where=np.isfinite(x), out=np.full(x.shape, np.inf)).max(initial=0) < 2.0 ** 52:
        return x.astype("i8")
    exact = [int(v) if np.isfinite(v) else int(w) * scale for v, w in zip(x.ravel(), values.ravel(), strict=True)]
    return np.array(exact, object).reshape(x.shape)


def to_planes(components: np.ndarray, planes: int) -> np.ndarray:
    """(n, planes) words of (n, 64) whole numbers; component 0 is the lowest bit."""
    out = np.empty((len(components), planes), "<u8")
    for p in range(planes):
        bits = (components >> p & 1).astype("u1")
        out[:, p] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def weights(planes: int) -> list[int]:
    return [1 << p for p in range(planes - 1)] + [-(1 << (planes - 1))]


def from_planes(words: np.ndarray) -> np.ndarray:
    """The components again."""
    n, planes = words.shape
    kind = "i8" if planes <= NARROW else object
    out = np.zeros((n, SIZE), kind)
    for p, w in enumerate(weights(planes)):
        bits = np.unpackbits(np.ascontiguousarray(words[:, p:p + 1]).view("u1"), axis=1, bitorder="little")
        out += bits.astype(kind) * w
    return out


def dots(words: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Dot products of (n, planes) vectors with one centroid's planes, by weighted AND-popcounts."""
    planes = words.shape[1]
    kind = "i8" if planes <= NARROW else object
    w = weights(planes)
    out = np.zeros(len(words), kind)
    for p in range(planes):
        column = np.ascontiguousarray(words[:, p])
        inner = np.zeros(len(words), kind)
        for q in range(planes):
            if centroid[q]:
                inner += np.bitwise_count(column & centroid[q]).astype(kind) * w[q]
        out += inner * w[p]
    return out


def nearest(words: np.ndarray, norms: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid; ties to the smaller number."""
    c = np.array(centroids, object)
    c_words = to_planes(c, words.shape[1])
    c_norms = (c * c).sum(1)
    best = number = None
    for k in range(len(centroids)):
        d = norms + c_norms[k] - 2 * dots(words, c_words[k])
        if best is None:
            best, number = d, np.zeros(len(d), "i4")
        else:
            less = np.asarray(d < best, bool)
            best, number = np.where(less, d, best), np.where(less, k, number).astype("i4")
    return number, best


def _is_kept(v: Column) -> Column:
    """64 components, none null or non-finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == SIZE) & ~bad


def kept_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part, components as doubles."""
    v = F.col(f"`{vector}`").cast("array<double>")
    return vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where(_is_kept(F.col("v")))


def plane_table(vectors: DataFrame, scale: int, planes: int) -> DataFrame:
    """(vec_id, words): the planes of every vector as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                x = scaled(part.column(1).flatten().to_numpy().reshape(-1, SIZE), scale)
                words = to_planes(x, planes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([w.tobytes() for w in words], pa.binary())],
                                                 ["vec_id", "words"])

    return vectors.mapInArrow(run, "vec_id long, words binary")


def _pieces(batch: pa.RecordBatch, planes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch of (vec_id, words): rows, planes, components and squared lengths."""
    for at in range(0, batch.num_rows, PIECE):
        part = batch.slice(at, PIECE)
        words = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(-1, planes)
        x = from_planes(words)
        yield part, words, x, (x * x).sum(1)


def cluster_sums(table: DataFrame, planes: int, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Per cluster the number of vectors and the sum of each component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        sums, counts = np.zeros((k, SIZE), object), [0] * k
        for batch in batches:
            for _, words, x, norms in _pieces(batch, planes):
                number, _ = nearest(words, norms, centroids)
                for c in np.unique(number).tolist():
                    mine = x[number == c]
                    counts[c] += len(mine)
                    sums[c] += mine.sum(0).astype(object)
        rows: list[tuple] = []
        for c in range(k):
            if counts[c]:
                rows.append((c, -1, 0, counts[c]))
                for j, total in enumerate(sums[c]):
                    rest, limb = int(total), 0
                    while not -(1 << LIMB - 1) <= rest < 1 << LIMB - 1:  # limbs from the lowest; the last has the sign
                        rows.append((c, j, limb, rest & ((1 << LIMB) - 1)))
                        rest, limb = rest >> LIMB, limb + 1
                    rows.append((c, j, limb, rest))
        if rows:
            columns = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             ["cluster", "component", "limb", "value"])

    parts = table.mapInArrow(run, "cluster int, component int, limb int, value long")
    added = parts.groupBy("cluster", "component", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in added.collect():  # a number per centroid, component and limb
        n, sums = out.get(r["cluster"], (0, [0] * SIZE))
        if r["component"] < 0:
            n = int(r["value"])
        else:
            sums[r["component"]] += int(r["value"]) << LIMB * r["limb"]
        out[r["cluster"]] = n, sums
    return out


def assigned(table: DataFrame, planes: int, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance as a decimal string)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, _, norms in _pieces(batch, planes):
                number, d = nearest(words, norms, centroids)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(number, pa.int32()), pa.array([str(x) for x in d.tolist()])],
                    ["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance string")


def first_centroids(table: DataFrame, planes: int, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids hash least, in the order of their hashes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = table.orderBy(digest.asc_nulls_last(), "words").limit(k).select("words").collect()
    return [[int(x) for x in from_planes(np.frombuffer(r["words"], "<u8").reshape(1, planes))[0]] for r in rows]


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3,
              vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    kept = kept_vectors(vectors, vec_id, vector)
    most = kept.select(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0] or 0.0
    planes = planes_needed(np.array([v for x in (most, -most) for v in scaled(np.array([x]), scale)], object))
    table = stored(plane_table(kept, scale, planes), "planes")
    centroids = first_centroids(table, planes, k, seed)
    for _ in range(rounds if centroids else 0):
        sums = cluster_sums(table, planes, centroids)
        moved = [[s // sums[c][0] for s in sums[c][1]] if c in sums else old for c, old in enumerate(centroids)]
        if moved == centroids:
            break
        centroids = moved
    placed = assigned(table, planes, centroids).withColumn("_d", F.expr("try_cast(distance as decimal(38,0))"))
    placed = stored(placed, "assigned")  # distances exact up to 38 digits, and a long where they fit
    per = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("_d").alias("s")).collect()}
    per_cluster = [_long(per.get(c)) for c in range(len(centroids))] or [None]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    at = F.col("cluster")
    return placed.select(
        "vec_id", "cluster", F.expr("try_cast(_d as bigint)").alias("distance"),
        F.get(F.array(*[F.lit(v).cast("long") for v in per_cluster]), at).alias("cluster_inertia"),
        F.lit(_long(None if None in per.values() else sum(per.values()))).cast("long").alias("inertia"),
        F.get(F.array(*[F.lit(d) for d in digests]), at).alias("centroid_sha256"))


def _long(value) -> int | None:
    return None if value is None or abs(value) >= 1 << 63 else int(value)
