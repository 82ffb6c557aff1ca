"""Fitted forests as tables of nodes: an evaluation of their own, and the check that their leaves hold the training rows.

A forest's nodes are model state (they do not grow with the rows once depth
and trees are set), so they are read whole and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.linear import added, sparse_rows
from parlance.session import scratch_path

_ROWS = 512  # rows made dense at once
_CELLS = 1 << 15


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees one after the other; a leaf is its own child."""

    roots: np.ndarray  # node of each tree's root
    feature: np.ndarray
    threshold: np.ndarray  # a row goes left if its value is at most this; NaN: by category
    categories: np.ndarray  # (nodes, arity): whether a category goes left
    left: np.ndarray
    right: np.ndarray
    stats: np.ndarray  # (nodes, classes): weights of the training rows in the node
    width: int

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.left == np.arange(len(self.left)))


def read_trees(spark, model) -> Trees:
    """The nodes of a fitted forest, from its saved form."""
    path = scratch_path(spark, "forests")
    model.write().save(path)
    rows = sorted(spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect(),
                  key=lambda r: (r["treeID"], r["id"]))  # model state
    place = {(r["treeID"], r["id"]): i for i, r in enumerate(rows)}
    n = len(rows)
    feature, threshold = np.zeros(n, "i4"), np.full(n, np.inf)
    left, right = np.arange(n), np.arange(n)
    arity = max((r["split"]["numCategories"] for r in rows if r["leftChild"] >= 0), default=0)
    categories = np.zeros((n, max(arity, 1)), bool)
    for i, r in enumerate(rows):
        if r["leftChild"] >= 0:
            left[i], right[i] = place[r["treeID"], r["leftChild"]], place[r["treeID"], r["rightChild"]]
            feature[i] = r["split"]["featureIndex"]
            values = r["split"]["leftCategoriesOrThreshold"]
            if r["split"]["numCategories"] < 0:
                threshold[i] = values[0]
            else:
                threshold[i] = np.nan
                categories[i, np.array(values, int)] = True
    roots = np.array([place[t, 0] for t in sorted({r["treeID"] for r in rows})])
    return Trees(roots, feature, threshold, categories, left, right, np.array([r["impurityStats"] for r in rows], float),
                 model.numFeatures)


def leaf_of(trees: Trees, x: np.ndarray) -> np.ndarray:
    """(rows, trees) leaf that each row of ``x`` falls into."""
    at = np.broadcast_to(trees.roots, (len(x), len(trees.roots))).copy()
    row = np.arange(len(x))[:, None]
    by_category = np.isnan(trees.threshold)
    most = trees.categories.shape[1] - 1
    while True:
        value = x[row, trees.feature[at]]
        goes_left = np.where(by_category[at], trees.categories[at, np.clip(value, 0, most).astype(int)],
                             value <= trees.threshold[at])
        below = np.where(goes_left, trees.left[at], trees.right[at])
        if (below == at).all():
            return at
        at = below


def _dense(vectors: pa.StructArray, width: int) -> np.ndarray:
    pointers, indices, values = sparse_rows(vectors)
    out = np.zeros((len(pointers) - 1, width))
    out[np.repeat(np.arange(len(out)), np.diff(pointers)), indices] = values
    return out


def votes(trees: Trees, x: np.ndarray) -> np.ndarray:
    """(rows, classes): summed class shares of the leaves."""
    shares = trees.stats / np.maximum(trees.stats.sum(1, keepdims=True), 1e-300)
    return shares[leaf_of(trees, x)].sum(1)


def leaf_counts(rows: DataFrame, trees: Trees) -> np.ndarray:
    """(nodes, classes): rows {features, label: class number} in each leaf, each counted once."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    nodes, classes = trees.stats.shape
    step = max(1, _CELLS // classes)

    def run(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros((nodes, classes))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                leaf = leaf_of(shared.value, _dense(part.column(0), shared.value.width))
                label = part.column(1).to_numpy(zero_copy_only=False).astype("i4")
                np.add.at(counts, (leaf.ravel(), np.repeat(label, leaf.shape[1])), 1)
        for b in range(0, nodes, step):
            yield b // step, counts[b:b + step].ravel()

    out = np.zeros((nodes, classes))
    for block, values in added(rows.select("features", F.col("label").cast("int").alias("label")), run).items():
        out[block * step:(block + 1) * step] = values.reshape(-1, classes)
    return out


def leaf_deviation(counts: np.ndarray, trees: Trees) -> float:
    """Largest deviation of a leaf's class weight from its rows, in standard deviations of the bootstrap.

    Each tree weighs each training row by a Poisson number of mean 1, so a
    weight is Poisson about its number of rows, and zero where there are none.
    """
    have, want = trees.stats[trees.leaves], counts[trees.leaves]
    if (have[want == 0] != 0).any():
        return float("inf")
    return float((np.abs(have - want) / np.sqrt(np.maximum(want, 1))).max(initial=0))


def one_vs_rest_classes(rows: DataFrame, forests: Sequence[Trees], features: str = "features", out: str = "_class") -> DataFrame:
    """Replaces ``features`` by the class whose binary forest votes most for it, evaluated from the nodes."""
    shared = rows.sparkSession.sparkContext.broadcast(list(forests))
    kept = [f for f in rows.schema.fields if f.name != features]
    given = rows.select(*[F.col(f"`{f.name}`").alias(f"_c{i}") for i, f in enumerate(kept)], F.col(features).alias("_v"))
    schema = ", ".join([f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)] + ["_class int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = _dense(part.column(len(kept)), shared.value[0].width)
                raw = np.stack([votes(t, x)[:, 1] for t in shared.value], 1)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(raw.argmax(1), pa.int32())],
                                                 [*[f"_c{i}" for i in range(len(kept))], "_class"])

    done = given.mapInArrow(run, schema)
    return done.select(*[F.col(f"_c{i}").alias(f.name) for i, f in enumerate(kept)], F.col("_class").alias(out))
