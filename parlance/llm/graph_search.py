"""Nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are dealt to shards of a bounded number of rows by a hash of their id.
In each shard every distinct vector is a node.  The graph starts random; all
nodes are then taken in batches: a greedy beam search from the medoid proposes
neighbours, robust pruning keeps a candidate only if no kept neighbour is
nearer to it by the factor alpha (first pass 1, second pass relaxed), and
reverse edges are added and pruned alike.  A query's beam search in each shard
gives its nearest there; the few rows per query and shard are then ranked.

A shard's rows and, after them, all queries go to one task, which builds the
graph and searches it block by block of queries, so it holds one shard's graph
and one block.  Shards hold at most 16,384 rows: a beam search costs nearly the
same in a large graph as in a small one, so fewer shards are fewer searches.
Scores are recomputed in double precision from the original vectors.

Cases: rows with a null id, and vectors that are null, empty, all zero, or
hold null or non-finite components take no part; only vectors of equal length
are compared; equal vectors share a node that lists its least ids, so ties are
exact; repeated rows (equal id and vector) are one candidate; rows of one id
with different vectors are all candidates, and a query of such an id asks by the
least of its vectors; fewer candidates than asked for are all
returned; columns other than id and vector are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import stored


@dataclass(frozen=True)
class GraphParams:
    degree: int = 24
    build_beam: int = 48
    search_beam: int = 128
    alpha: float = 1.2
    batch: int = 256
    shard_rows: int = 16384
    least_rows: int = 4096
    spread: int = 16
    query_block: int = 512


def _squared(x: np.ndarray, norms: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of rows q (b, d) to x[ids] (b, c), up to the rounding of norms."""
    dots = np.einsum("bcd,bd->bc", x[ids], q, optimize=True)
    return np.maximum(norms[ids] - 2 * dots + (q * q).sum(1)[:, None], 0)


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int,
                width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the ``beam`` nearest nodes met, all queries at once; -1 and inf fill up.

    In each step every query expands its ``width`` nearest nodes not yet
    expanded, until none of its beam is left.
    """
    n_q = len(queries)
    ids = np.full((n_q, beam), -1)
    dist = np.full((n_q, beam), np.inf, "f4")
    done = np.ones((n_q, beam), bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = _squared(x, norms, ids[:, :1], queries)[:, 0]
    seen = np.zeros((n_q, len(x)), bool)
    seen[:, entry] = True
    mark = np.zeros((n_q, len(x)), "i2")
    active = np.arange(n_q)
    while len(active):
        order = np.argsort(done[active], axis=1, kind="stable")[:, :width]  # nearest first, as beams are sorted
        fresh = ~np.take_along_axis(done[active], order, 1)
        current = np.take_along_axis(ids[active], order, 1)
        done[active[:, None], order] = True
        near = graph[np.where(fresh, current, 0)]
        near = np.where(fresh[:, :, None], near, -1).reshape(len(active), -1)
        rows = active[:, None]
        safe = np.maximum(near, 0)
        new = (near >= 0) & ~seen[rows, safe]
        place = np.broadcast_to(np.arange(near.shape[1], dtype="i2"), near.shape)
        mark[np.broadcast_to(rows, near.shape)[new], near[new]] = place[new]
        new &= mark[rows, safe] == place  # each node once per step
        seen[np.broadcast_to(rows, near.shape)[new], near[new]] = True
        d = np.where(new, _squared(x, norms, safe, queries[active]), np.inf)
        all_ids = np.concatenate([ids[active], np.where(new, near, -1)], 1)
        all_dist = np.concatenate([dist[active], d], 1)
        all_done = np.concatenate([done[active], ~new], 1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        dist[active] = np.take_along_axis(all_dist, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
        active = active[~done[active].all(1)]
    return ids, dist


def robust_prune(x: np.ndarray, norms: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int,
                 alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each node among its candidates (-1: none)."""
    own = nodes[:, None]
    d = np.where((candidates >= 0) & (candidates != own), _squared(x, norms, np.maximum(candidates, 0), x[nodes]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    alive = np.isfinite(d)
    out = np.full((len(nodes), degree), -1)
    vectors = x[np.maximum(candidates, 0)]
    lengths = norms[np.maximum(candidates, 0)]
    every = np.arange(len(nodes))
    for k in range(degree):
        first = alive.argmax(1)
        has = alive[every, first]
        if not has.any():
            break
        picked = candidates[every, first]
        out[has, k] = picked[has]
        q = x[np.maximum(picked, 0)]
        between = np.maximum(lengths - 2 * np.einsum("bcd,bd->bc", vectors, q, optimize=True)
                             + (q * q).sum(1)[:, None], 0)
        alive &= ~((alpha * alpha * between <= d) & has[:, None])
        alive[every, first] = False
        alive &= candidates != picked[:, None]
    return out


def build_graph(x: np.ndarray, p: GraphParams, seed: int = 0) -> tuple[np.ndarray, int]:
    """(neighbours by node, entry node) of distinct vectors."""
    x = np.ascontiguousarray(x, "f4")
    n, norms = len(x), (x * x).sum(1)
    rng = np.random.default_rng(seed)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    slots = 2 * p.degree
    graph = np.full((n, slots), -1)
    if n > 1:
        start = rng.integers(0, n, (n, min(p.degree, n - 1)))
        graph[:, :start.shape[1]] = np.where(start == np.arange(n)[:, None], -1, start)
    for alpha in (1.0, p.alpha):
        order = rng.permutation(n)
        for at in range(0, n, p.batch):
            nodes = order[at:at + p.batch]
            met, _ = beam_search(x, norms, graph, entry, x[nodes], p.build_beam)
            kept = robust_prune(x, norms, nodes, np.concatenate([met, graph[nodes]], 1), p.degree, alpha)
            graph[nodes] = -1
            graph[nodes, :p.degree] = kept
            target, source = kept.ravel(), np.repeat(nodes, p.degree)
            on = target >= 0
            target, source = target[on], source[on]
            if not len(target):
                continue
            by = np.argsort(target, kind="stable")
            target, source = target[by], source[by]
            hit, first, counts = np.unique(target, return_index=True, return_counts=True)
            extra = np.full((len(hit), int(counts.max())), -1)
            extra[np.repeat(np.arange(len(hit)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
            lists = np.concatenate([graph[hit], extra], 1)
            lists = -np.sort(-lists, axis=1)  # the empty places last
            lists[:, 1:][lists[:, 1:] == lists[:, :-1]] = -1
            lists = -np.sort(-lists, axis=1)
            over = (lists >= 0).sum(1) > slots
            graph[hit[~over]] = lists[~over][:, :slots] if lists.shape[1] >= slots else -1
            if over.any():
                pruned = robust_prune(x, norms, hit[over], lists[over], p.degree, alpha)
                graph[hit[over]] = -1
                graph[hit[over], :p.degree] = pruned
    return graph, entry


@dataclass(frozen=True)
class Shard:
    """The index of one shard: distinct vectors with their graph, and the ids at each node."""

    vectors: np.ndarray  # (nodes, components), double
    graph: np.ndarray
    entry: int
    ids: np.ndarray  # ids by node, ascending within a node
    begin: np.ndarray  # each node's first place in ``ids``


def build_shard(ids: np.ndarray, vectors: np.ndarray, p: GraphParams) -> Shard:
    """The index of a shard's rows; repeated rows are one."""
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([node.ravel().astype("i8"), ids], 1), axis=0)
    graph, entry = build_graph(distinct, p)
    return Shard(distinct, graph, entry, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)))


def search_shard(of: Shard, query_ids: np.ndarray, queries: np.ndarray, k: int,
                 p: GraphParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vec ids, scores): each query's k nearest of the shard, by exact distance, ties by id, itself left out."""
    x = of.vectors.astype("f4")
    met, _ = beam_search(x, (x * x).sum(1), of.graph, of.entry, queries.astype("f4"), max(p.search_beam, 2 * k))
    out = []
    for i, q in enumerate(queries):
        found = met[i][met[i] >= 0]
        score = np.sqrt(((of.vectors[found] - q) ** 2).sum(1))
        places = [np.arange(of.begin[f], min(of.begin[f + 1], of.begin[f] + k + 1)) for f in found]
        cand = of.ids[np.concatenate(places)]
        scores = np.repeat(score, [len(x) for x in places])
        on = cand != query_ids[i]
        cand, scores = cand[on], scores[on]
        best = np.lexsort((cand, scores))[:k]
        out.append((np.full(len(best), query_ids[i]), cand[best], scores[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def valid_vectors(df: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = (F.col("vec_id").isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
            & F.exists(v, lambda x: x != 0))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"), fine.alias("_fine")) \
        .where("_fine").drop("_fine")


def _shards(n: Column, p: GraphParams) -> Column:
    """Shards of a length's ``n`` rows: of at most ``shard_rows``, and of fewer where that gives fewer than ``spread`` shards."""
    few = F.least(F.lit(p.spread), F.ceil(n / p.least_rows))
    return F.greatest(F.lit(1), F.ceil(n / p.shard_rows), few).cast("int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, p: GraphParams = GraphParams()) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest among ``vectors`` (both vec_id, embedding).

    A shard is a partition: its rows come first, then the queries of its length, one after the other.  A task so
    builds its graph once and holds it, one block of queries and nothing else; no graph is written, shuffled or copied.
    """
    sizes = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    shards = sizes.select("dim", _shards(F.col("n"), p).alias("shards"))
    first = F.sum("shards").over(Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1))  # a row per length
    shards = stored(shards.select("dim", "shards", F.coalesce(first, F.lit(0)).cast("int").alias("first")), "dims")
    total = shards.agg(F.sum("shards")).first()[0] or 1

    sized = vectors.withColumn("dim", F.size("embedding")).join(F.broadcast(shards), "dim")  # a row per length
    dealt = sized.select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("shards"))).cast("int").alias("shard"),
                         F.lit(False).alias("asks"), "vec_id", "embedding")
    asked = (queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
             .withColumn("dim", F.size("embedding")).join(F.broadcast(shards), "dim"))
    every = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1)).alias("shard")
    asked = asked.select(every, F.lit(True).alias("asks"), "vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, index = None, [], None
        for batch in batches:
            of = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
                if of[part[0]] != now:
                    now, rows, index = of[part[0]], [], None
                cut = batch.slice(part[0], len(part))
                asks = cut.column(1).to_numpy(zero_copy_only=False)
                ids, x = cut.column(2).to_numpy(), cut.column(3).flatten().to_numpy().reshape(len(part), -1)
                if not asks.all():
                    rows.append((ids[~asks], x[~asks]))
                ids, x = ids[asks], x[asks]
                for at in range(0, len(ids) if rows else 0, p.query_block):
                    if index is None:  # the shard's rows are all there, as they come before the queries
                        index = build_shard(*(np.concatenate(c) for c in zip(*rows, strict=True)), p)
                    found = search_shard(index, ids[at:at + p.query_block], x[at:at + p.query_block], k, p)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    found = (dealt.unionByName(asked).repartitionById(total, "shard").sortWithinPartitions("shard", "asks")
             .select("shard", "asks", "vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double"))
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy("score", "vec_id")))  # k rows per shard
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
