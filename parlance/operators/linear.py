"""Many binary logistic regressions over the same rows, fitted together (M2, M3).

All K models are one matrix of K x D coefficients.  A pass over the rows
computes the margins of all models as one sparse x dense product per batch,
and from them every model's loss and gradient; the driver takes one L-BFGS
step per model from it.  So the number of scans is that of the slowest model
and does not grow with K, and no row is copied per model.

A row belongs to model k if it is of the model's group (e.g. its domain) and,
where there is a negative label, has the model's label or the negative one.
The objective is that of Spark's LogisticRegression with standardisation:
mean log loss + reg / 2 * sum over features of (deviation * coefficient)^2,
the deviation being taken over the model's own rows; intercepts are free.

The same pass at fitted coefficients gives the residual of a fit
(``residuals``): the length of the objective's gradient, which is zero at its
only minimum and nowhere else, divided by its length at zero coefficients.

The rows are packed once into blocks of bytes (``pack``), which every pass
reads; converting a vector row by row costs several times what a pass computes.

What reaches the driver per pass is a number per coefficient, added up by Spark
in blocks of buckets; it holds ``2 * HISTORY + 4`` such matrices, so ``fit``
takes the models in parts of at most ``MAX_CELLS`` coefficients.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.labels import OTHER
from parlance.session import scratch_path

HISTORY = 6
FEW = 10_000  # models whose names may be broadcast
MAX_CELLS = 4_000_000  # coefficients fitted at once: 32 MB a matrix
_CELLS = 1 << 15  # numbers in one shuffled block of a gradient
_ROWS = 2048  # rows multiplied at once


@dataclass(frozen=True)
class Keys:
    """The models of a set: label and group of each, and the label of their negatives (None: all other rows)."""

    labels: tuple[str, ...]
    groups: tuple[str | None, ...]
    negatives: str | None = None

    def part(self, begin: int, end: int) -> Keys:
        return Keys(self.labels[begin:end], self.groups[begin:end], self.negatives)


@dataclass(frozen=True)
class LinearSet:
    """K binary models: P(label k) = sigmoid(intercept k + coefficients k . x)."""

    domains: tuple[str, ...]
    classifiers: tuple[str, ...]
    coefficients: np.ndarray  # (K, D)
    intercepts: np.ndarray  # (K,)

    @property
    def width(self) -> int:
        return self.coefficients.shape[1]

    def __len__(self) -> int:
        return len(self.classifiers)


def sparse_rows(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row pointers, indices, values) of a batch of ml vectors, sparse or dense."""
    kind = vectors.field("type").to_numpy(zero_copy_only=False)
    lists = vectors.field("values")
    lengths = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    pointers = np.concatenate([[0], np.cumsum(lengths)])
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (kind == 0).all():
        return pointers, vectors.field("indices").flatten().to_numpy(zero_copy_only=False), values
    own = vectors.field("indices").to_pylist()
    indices = [np.arange(n) if k else np.array(i, "i4") for k, i, n in zip(kind, own, lengths, strict=True)]
    return pointers, np.concatenate(indices) if indices else np.empty(0, "i4"), values


def margins(pointers: np.ndarray, indices: np.ndarray, values: np.ndarray, weights: Sequence[np.ndarray],
            intercepts: np.ndarray) -> np.ndarray:
    """(rows, K) margins; ``weights`` has the D coefficients of each model."""
    out = np.tile(intercepts, (len(pointers) - 1, 1))
    full = np.flatnonzero(np.diff(pointers))
    if len(full):
        for k in range(out.shape[1]):  # a column at a time: several times faster than rows of a few columns, and no copy of all
            out[full, k] += np.add.reduceat(values * weights[k].take(indices), pointers[full])
    return out


def _by_bucket(pointers: np.ndarray, indices: np.ndarray, values: np.ndarray, error: np.ndarray, cells: Sequence[np.ndarray]) -> None:
    """Adds to each model's D ``cells`` the values times their rows' ``error`` (rows, K)."""
    lengths = np.diff(pointers)
    for k, own in enumerate(cells):
        own += np.bincount(indices, values * np.repeat(np.ascontiguousarray(error[:, k]), lengths), len(own))


def _codes(names: Sequence) -> dict:
    return {x: i for i, x in enumerate(dict.fromkeys(names))}


@dataclass(frozen=True)
class Packed:
    """Training rows as blocks of at most ``_ROWS`` rows: row pointers, indices, values and codes as bytes.

    Passes read these instead of the vectors: no row is taken apart or converted again.  Codes number the labels and
    groups that some model names; any other is -1.  Where models have rows of their own (``apart``), a block's rows are
    ordered by group and label, so a pass computes for each run of them only the models that it belongs to.
    """

    blocks: DataFrame
    labels: dict
    groups: dict
    apart: bool


_BLOCK = "n int, pointers binary, indices binary, places string, values binary, kind string, labels binary, groups binary"


def _picked(pointers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row pointers, places in indices and values) of some rows."""
    lengths = np.diff(pointers)[rows]
    out = np.concatenate([[0], np.cumsum(lengths)])
    return out, np.arange(out[-1]) + np.repeat(pointers[:-1][rows] - out[:-1], lengths)


def pack(rows: DataFrame, keys: Keys) -> Packed:
    """Rows {features, label, group} as blocks, written once to the shared scratch folder."""
    labels, groups = _codes((*keys.labels, keys.negatives)), _codes(keys.groups)
    spark = rows.sparkSession
    names = spark.sparkContext.broadcast((labels, groups))
    apart = keys.negatives is not None or any(g is not None for g in keys.groups)

    def block(pointers, indices, values, label, group) -> pa.RecordBatch:
        small = len(values) and (values >= 0).all() and (values <= 65535).all() and (values == np.floor(values)).all()
        kind = "<f8" if not small else "<u2" if values.max() > 255 else "u1"
        places = "<u2" if indices.max(initial=0) <= 65535 else "<i4"
        data = {"pointers": pointers.astype("<i8"), "indices": indices.astype(places), "places": places,
                "values": values.astype(kind), "kind": kind, "labels": label, "groups": group}
        return pa.RecordBatch.from_pydict({"n": pa.array([len(label)], pa.int32()), **{
            k: [x] if isinstance(x, str) else pa.array([x.tobytes()], pa.binary()) for k, x in data.items()}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_label, of_group = names.value
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                pointers, indices, values = sparse_rows(part.column(0))
                label = np.array([of_label.get(x, -1) for x in part.column(1).to_pylist()], "<i4")
                group = np.array([of_group.get(x, -1) for x in part.column(2).to_pylist()], "<i4")
                if apart:
                    order = np.lexsort((label, group))
                    pointers, places = _picked(pointers, order)
                    indices, values, label, group = indices[places], values[places], label[order], group[order]
                yield block(pointers, indices, values, label, group)

    path = scratch_path(spark, "packed")
    rows.select("features", "label", "group").mapInArrow(run, _BLOCK).write.option("compression", "none").parquet(path)
    return Packed(spark.read.schema(_BLOCK).parquet(path), labels, groups, apart)


def _membership(keys: Keys, of: Packed, label: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, K): whether a row belongs to a model, and is its positive."""
    own = np.array([of.groups[g] for g in keys.groups])
    positive = label[:, None] == np.array([of.labels[x] for x in keys.labels])
    mine = np.array([g is None for g in keys.groups]) | (group[:, None] == own)
    if keys.negatives is not None:
        mine = mine & (positive | (label[:, None] == of.labels[keys.negatives]))
    return mine, positive & mine


def _batches(batches: Iterator[pa.RecordBatch], apart: bool):
    """(row pointers, indices, values, label codes, group codes) of packed blocks, or with ``apart`` of their runs of rows."""
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            read = lambda name, kind: np.frombuffer(columns[name][i].as_buffer(), kind)
            pointers, labels, groups = read("pointers", "<i8"), read("labels", "<i4"), read("groups", "<i4")
            indices, values = read("indices", columns["places"][i].as_py()), read("values", columns["kind"][i].as_py())
            changes = np.flatnonzero((np.diff(labels) != 0) | (np.diff(groups) != 0)) + 1 if apart else []
            ends = [0, *changes, len(labels)]
            for b, e in zip(ends[:-1], ends[1:], strict=True):
                part = slice(pointers[b], pointers[e])
                yield pointers[b:e + 1] - pointers[b], indices[part].astype("i8"), values[part].astype("f8"), labels[b:e], groups[b:e]


def added(rows: DataFrame, run) -> dict[int, np.ndarray]:
    """Sums of the arrays that ``run`` gives per task under block numbers; -1 is a block of its own.

    Blocks are shuffled and added by streaming over the sorted partials, in
    the order of the tasks, so a group is never held and reruns agree.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for block, values in run(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([part], pa.int32()),
                 pa.array([values.astype("<f8").tobytes()], pa.binary())], ["block", "part", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        out = lambda: pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "data"])
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                values = np.frombuffer(data.as_buffer(), "<f8")
                if block != now:
                    if total is not None:
                        yield out()
                    now, total = block, values.copy()
                else:
                    total += values
        if total is not None:
            yield out()

    parts = rows.mapInArrow(emit, "block int, part int, data binary")
    summed = (parts.repartition("block").sortWithinPartitions("block", "part")
              .mapInArrow(add, "block int, data binary"))
    return {r["block"]: np.frombuffer(r["data"], "<f8") for r in summed.collect()}  # a number per coefficient


class Pass:
    """Passes over packed rows for the models ``keys``."""

    def __init__(self, packed: Packed, keys: Keys, width: int):
        self.rows, self.names, self.keys, self.width, self.k = packed.blocks, replace(packed, blocks=None), keys, width, len(keys.labels)
        self.step = max(1, _CELLS // max(1, self.k))  # buckets in a block
        self.scans = 0

    def _sums(self, head: int, accumulate, state) -> tuple[np.ndarray, np.ndarray]:
        """``accumulate(state, batch, head row, (D, m) array)`` summed over all rows."""
        width, step, wide = self.width, self.step, state["wide"]
        shared, apart = self.rows.sparkSession.sparkContext.broadcast(state), self.names.apart

        def run(batches: Iterator[pa.RecordBatch]):
            first, cells = np.zeros(head), np.zeros((width, wide), order="F")  # a model's column is added to as one
            for batch in _batches(batches, apart):
                accumulate(shared.value, batch, first, cells)
            yield -1, first
            for b in range(0, width, step):
                if cells[b:b + step].any():
                    yield b // step, cells[b:b + step].ravel()

        got = added(self.rows, run)
        self.scans += 1
        shared.unpersist()
        cells = np.zeros((width, wide))
        for block, values in got.items():
            if block >= 0:
                cells[block * step:(block + 1) * step] = values.reshape(-1, wide)
        return got.get(-1, np.zeros(head)), cells

    def moments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and positives per model, and the deviation (K, D) of each feature over the model's rows."""
        k, keys, names = self.k, self.keys, self.names

        def accumulate(state, batch, first, cells):
            pointers, indices, values, labels, groups = batch
            mine, positive = _membership(keys, names, labels, groups)
            first[:k] += mine.sum(0)
            first[k:] += positive.sum(0)
            row = np.repeat(np.arange(len(labels)), np.diff(pointers))
            width = len(cells)
            for i in np.flatnonzero(mine.any(0)):
                on = mine[row, i]
                cells[:, i] += np.bincount(indices[on], values[on], width)
                cells[:, k + i] += np.bincount(indices[on], values[on] ** 2, width)

        first, cells = self._sums(2 * k, accumulate, {"wide": 2 * k})
        n, total, square = first[:k], cells[:, :k].T, cells[:, k:].T
        m = np.maximum(n, 1)[:, None]
        variance = (square - total * total / m) / np.maximum(m - 1, 1)
        return n, first[k:], np.sqrt(np.maximum(variance, 0))

    def gradient(self, coefficients: np.ndarray, intercepts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed log loss (K,), and its gradients by coefficients (K, D) and intercepts (K,)."""
        k, keys, names = self.k, self.keys, self.names

        def accumulate(state, batch, first, cells):
            pointers, indices, values, labels, groups = batch
            mine, positive = _membership(keys, names, labels, groups)
            on = np.flatnonzero(mine.any(0))  # the models that the run belongs to
            mine, positive = mine[:, on], positive[:, on]
            z = margins(pointers, indices, values, [state["weights"][i] for i in on], state["intercepts"][on])
            with np.errstate(over="ignore"):
                error = np.where(mine, 1 / (1 + np.exp(-z)) - positive, 0.0)
            first[on] += np.where(mine, np.logaddexp(0, z) - np.where(positive, z, 0), 0.0).sum(0)
            first[k + on] += error.sum(0)
            _by_bucket(pointers, indices, values, error, [cells[:, i] for i in on])

        state = {"wide": k, "weights": np.ascontiguousarray(coefficients), "intercepts": intercepts}
        first, cells = self._sums(2 * k, accumulate, state)
        return first[:k], cells.T, first[k:]


    def softmax_gradient(self, coefficients: np.ndarray, intercepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the summed log loss of one model whose classes are the keys' labels."""
        k, keys, names = self.k, self.keys, self.names

        def accumulate(state, batch, first, cells):
            pointers, indices, values, labels, groups = batch
            _, positive = _membership(keys, names, labels, groups)
            z = margins(pointers, indices, values, list(state["weights"]), state["intercepts"])
            e = np.exp(z - z.max(1, keepdims=True))
            error = e / e.sum(1, keepdims=True) - positive
            first[:k] += error.sum(0)
            _by_bucket(pointers, indices, values, error, list(cells.T))

        state = {"wide": k, "weights": np.ascontiguousarray(coefficients), "intercepts": intercepts}
        first, cells = self._sums(k, accumulate, state)
        return cells.T, first


class _Objective:
    """The models' objectives in standardised coefficients; the last column is the intercept."""

    def __init__(self, over: Pass, reg: float):
        self.over, self.reg = over, reg
        self.n, self.positives, self.deviation = over.moments()
        self.scale = np.divide(1.0, self.deviation, out=np.zeros_like(self.deviation), where=self.deviation > 0)
        self.fits = (self.positives > 0) & (self.positives < self.n)  # a model of one class has no minimum

    def start(self) -> np.ndarray:
        x = np.zeros((self.over.k, self.over.width + 1))
        p, n = self.positives[self.fits], self.n[self.fits]
        x[self.fits, -1] = np.log(p / (n - p))
        return x

    def at(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss, by_weight, by_intercept = self.over.gradient(x[:, :-1] * self.scale, x[:, -1])
        n = np.maximum(self.n, 1)
        f = loss / n + self.reg / 2 * (x[:, :-1] ** 2).sum(1)
        g = np.empty_like(x)
        g[:, :-1] = by_weight / n[:, None] * self.scale + self.reg * x[:, :-1]
        g[:, -1] = by_intercept / n
        f[~self.fits], g[~self.fits] = 0, 0
        return f, g


def _minimise(objective: _Objective, tol: float, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """L-BFGS for all models at once, each until its gradient is ``tol`` of the first; the points and their gradients' lengths."""
    x = objective.start()
    f, g = objective.at(x)
    k, p = x.shape
    s, y = np.zeros((HISTORY, k, p)), np.zeros((HISTORY, k, p))
    rho = np.zeros((HISTORY, k))
    length = np.linalg.norm(g, axis=1)
    short = tol * length
    going = length > short
    d = -g
    t = np.minimum(1.0, 1 / np.maximum(length, 1e-300))
    tries = np.zeros(k, int)
    for _ in range(max_iter):
        if not going.any():
            break
        trial = np.where(going[:, None], x + t[:, None] * d, x)
        f_new, g_new = objective.at(trial)
        slope = (g * d).sum(1)
        # close to the minimum the loss no longer tells; there a shorter gradient does
        good = going & ((f_new <= f + 1e-4 * t * slope)
                        | ((np.abs(f_new - f) < 1e-12 * np.maximum(1, np.abs(f)))
                           & (np.linalg.norm(g_new, axis=1) < length)))
        step, change = trial - x, g_new - g
        curve = (step * change).sum(1)
        keep = good & (curve > 1e-300)
        s[1:, keep], y[1:, keep], rho[1:, keep] = s[:-1, keep], y[:-1, keep], rho[:-1, keep]
        s[0, keep], y[0, keep], rho[0, keep] = step[keep], change[keep], 1 / curve[keep]
        x, f, g = np.where(good[:, None], trial, x), np.where(good, f_new, f), np.where(good[:, None], g_new, g)
        length = np.linalg.norm(g, axis=1)
        tries = np.where(good, 0, tries + 1)
        going &= (length > short) & (tries < 30)
        q, alpha = g.copy(), np.zeros((HISTORY, k))
        for i in range(HISTORY):
            alpha[i] = rho[i] * (s[i] * q).sum(1)
            q -= alpha[i][:, None] * y[i]
        size = (y[0] ** 2).sum(1)
        q *= np.where(rho[0] > 0, np.divide(1 / np.where(rho[0] > 0, rho[0], 1), size, out=np.ones(k), where=size > 0), 1)[:, None]
        for i in reversed(range(HISTORY)):
            q += s[i] * (alpha[i] - rho[i] * (y[i] * q).sum(1))[:, None]
        d = np.where(good[:, None], -q, d)
        first = good & (rho[0] == 0)
        t = np.where(good, np.where(first, np.minimum(1, 1 / np.maximum(length, 1e-300)), 1.0), t / 2)
    return x, length


def fit(rows: DataFrame, keys: Keys, width: int, reg: float, domains: Sequence[str] | None = None, tol: float = 1e-5,
        max_iter: int = 200) -> tuple[LinearSet, int]:
    """The models of ``keys`` on rows {features, label, group}, and the number of scans.

    A model is done when its gradient is ``tol`` of that at zero coefficients.

    A model whose rows are of one class gives that class always, as Spark's
    own does: coefficients 0 and an infinite intercept.
    """
    part = max(1, MAX_CELLS // max(1, width))
    coefficients, intercepts, scans = [], [], 0
    packed = pack(rows, keys) if keys.labels else None
    for begin in range(0, len(keys.labels), part):
        over = Pass(packed, keys.part(begin, begin + part), width)
        objective = _Objective(over, reg)
        x, _ = _minimise(objective, tol, max_iter)
        w, b = x[:, :-1] * objective.scale, x[:, -1].copy()
        b[~objective.fits] = np.where(objective.positives[~objective.fits] > 0, np.inf, -np.inf)
        coefficients.append(w)
        intercepts.append(b)
        scans += over.scans
    names = tuple(domains) if domains is not None else tuple(g or "" for g in keys.groups)
    return LinearSet(names, keys.labels, np.concatenate(coefficients) if coefficients else np.zeros((0, width)),
                     np.concatenate(intercepts) if intercepts else np.zeros(0)), scans


def residuals(rows: DataFrame, keys: Keys, models: LinearSet, reg: float) -> np.ndarray:
    """Per model the gradient's length at its coefficients, divided by that at zero coefficients; 0 if it fits one class.

    The rows are packed once; one pass for the deviations and two for the gradients.  Changing any
    coefficient or intercept of a fitted model makes its number larger.
    """
    out = []
    part = max(1, MAX_CELLS // max(1, models.width))
    packed = pack(rows, keys) if keys.labels else None
    for begin in range(0, len(keys.labels), part):
        objective = _Objective(Pass(packed, keys.part(begin, begin + part), models.width), reg)
        w, b = models.coefficients[begin:begin + part], models.intercepts[begin:begin + part]
        finite = np.isfinite(b)
        x = np.concatenate([w * objective.deviation, np.where(finite, b, 0)[:, None]], axis=1)
        # a coefficient of a feature that never varies moves no standardised one, but must be zero
        stray = np.abs(np.where(objective.deviation > 0, 0, w)).sum(1)
        _, g = objective.at(x)
        _, g0 = objective.at(objective.start())
        ratio = np.linalg.norm(g, axis=1) / np.maximum(np.linalg.norm(g0, axis=1), 1e-300) + stray
        one_class = np.where(finite | (np.abs(w).sum(1) > 0), np.inf, 0.0)
        out.append(np.where(objective.fits, np.where(finite, ratio, np.inf), one_class))
    return np.concatenate(out) if out else np.zeros(0)


def softmax_residual(rows: DataFrame, labels: Sequence[str], coefficients: np.ndarray, intercepts: np.ndarray,
                     reg: float) -> float:
    """``residuals`` of one model of several classes (rows of ``coefficients``), over all of its coefficients."""
    keys = Keys(tuple(labels), (None,) * len(labels))
    over = Pass(pack(rows, keys), keys, coefficients.shape[1])
    n, positives, deviation = over.moments()
    total, deviation = max(n[0], 1), deviation[0]
    scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)

    def length(w: np.ndarray, b: np.ndarray) -> float:
        by_weight, by_intercept = over.softmax_gradient(w, b)
        g = by_weight / total * scale + reg * w * deviation
        return float(np.sqrt((g ** 2).sum() + ((by_intercept / total) ** 2).sum()))

    share = np.log(np.maximum(positives, 1e-300) / total)
    stray = float(np.abs(np.where(deviation > 0, 0, coefficients)).sum())
    return length(coefficients, intercepts) / max(length(np.zeros_like(coefficients), share), 1e-300) + stray


# ---------------------------------------------------------------- scoring
def subset(models: LinearSet, places: Sequence[int]) -> LinearSet:
    at = list(places)
    return LinearSet(tuple(models.domains[i] for i in at), tuple(models.classifiers[i] for i in at),
                     models.coefficients[at], models.intercepts[at])


def scores(rows: DataFrame, parts: Sequence[tuple[str, LinearSet]], out: str = "scores", columns: int = 256) -> DataFrame:
    """Replaces the feature columns by ``out``: P(classifier) of all models, part by part.

    ``parts`` names the vector column that each set of models reads.  A sparse
    x dense product per batch of rows and block of ``columns`` models: the plan
    is the same for any number of models.  The coefficients are model state
    that does not grow with the rows; they are broadcast once.
    """
    state = rows.sparkSession.sparkContext.broadcast(
        [(np.ascontiguousarray(m.coefficients), m.intercepts) for _, m in parts])
    vectors = list(dict.fromkeys(c for c, _ in parts))
    kept = [f for f in rows.schema.fields if f.name not in vectors]
    given = rows.select(*[F.col(f"`{f.name}`").alias(f"_c{i}") for i, f in enumerate(kept)],
                        *[F.col(c).alias(f"_v{i}") for i, c in enumerate(vectors)])
    schema = ", ".join([f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)] + ["_scores array<double>"])
    reads = [len(kept) + vectors.index(c) for c, _ in parts]
    k = sum(len(m) for _, m in parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                p, begin = np.empty((part.num_rows, k)), 0
                for place, (weights, intercepts) in zip(reads, state.value, strict=True):
                    matrix = sparse_rows(part.column(place))
                    for c in range(0, len(intercepts), columns):
                        z = margins(*matrix, weights[c:c + columns], intercepts[c:c + columns])
                        with np.errstate(over="ignore"):
                            p[:, begin + c:begin + c + z.shape[1]] = 1 / (1 + np.exp(-z))
                    begin += len(intercepts)
                offsets = pa.array(np.arange(part.num_rows + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(kept)], pa.ListArray.from_arrays(offsets, pa.array(p.ravel(), pa.float64()))],
                    [*[f"_c{i}" for i in range(len(kept))], "_scores"])

    scored = given.mapInArrow(run, schema)
    return scored.select(*[F.col(f"_c{i}").alias(f.name) for i, f in enumerate(kept)], F.col("_scores").alias(out))


def names(spark, models: LinearSet) -> DataFrame:
    """{place, domain, classifier}: a row per model, in the set's order."""
    table = pa.table({"place": pa.array(np.arange(len(models)), pa.int32()),
                      "domain": pa.array(models.domains, pa.string()),
                      "classifier": pa.array(models.classifiers, pa.string())})
    return spark.createDataFrame(table)


def to_table(spark, models: LinearSet) -> DataFrame:
    """{place, domain, classifier, intercept, coefficients}: the set as a table to be saved."""
    table = pa.table({"place": pa.array(np.arange(len(models)), pa.int32()),
                      "domain": pa.array(models.domains, pa.string()),
                      "classifier": pa.array(models.classifiers, pa.string()),
                      "intercept": pa.array(models.intercepts, pa.float64()),
                      "coefficients": pa.array(list(models.coefficients), pa.list_(pa.float64()))})
    return spark.createDataFrame(table)


def from_table(table: DataFrame, width: int) -> LinearSet:
    """The set again, in its order."""
    got = sorted(table.collect(), key=lambda r: r["place"])  # model state: a row per model
    matrix = np.array([r["coefficients"] for r in got], float).reshape(len(got), width)
    return LinearSet(tuple(r["domain"] for r in got), tuple(r["classifier"] for r in got), matrix,
                     np.array([r["intercept"] for r in got], float))


def stack(parts: list, width: int | None = None) -> np.ndarray:
    """Rows (of ``width`` numbers) or numbers as one array, also if there are none."""
    return np.array(parts, float).reshape((len(parts), width) if width is not None else len(parts))


def pairs(models: LinearSet, scores_col: str = "scores", domain_col: str | None = None) -> Column:
    """array<struct<label, score>> of a row's scores; with ``domain_col`` those of its domain (null: all).

    Names are one constant, so the expression is the same for any number of models.
    """
    names = F.from_json(F.lit(json.dumps([{"d": d, "c": c} for d, c in zip(models.domains, models.classifiers, strict=True)])),
                        "array<struct<d:string,c:string>>")
    every = F.zip_with(names, F.col(scores_col), lambda n, s: F.struct(n["d"].alias("d"), n["c"].alias("label"), s.alias("score")))
    if domain_col:
        every = F.filter(every, lambda x: F.col(domain_col).isNull() | (F.col(domain_col) == x["d"]))
    return F.transform(every, lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score")))


def long_form(scored: DataFrame, models: LinearSet, ids: Sequence[str], scores_col: str = "scores",
              domain_col: str | None = None) -> DataFrame:
    """{id..., domain, classifier, predictedLabel, score}: a row per row and model, names by a join with the model table.

    With ``domain_col`` a row keeps only the models of its domain (null: all).
    """
    spark = scored.sparkSession
    keep = [*ids, *([domain_col] if domain_col and domain_col not in ids else [])]
    rows = scored.select(*keep, F.posexplode(scores_col).alias("place", "score"))
    of = names(spark, models).withColumnsRenamed({"domain": "_domain"})
    if len(models) <= FEW:
        of = F.broadcast(of)
    out = rows.join(of, "place")
    if domain_col:
        out = out.where(F.col(domain_col).isNull() | (F.col(domain_col) == F.col("_domain")))
    label = F.when(F.col("score") > 0.5, F.col("classifier")).otherwise(F.lit(OTHER))
    return out.select(*ids, F.col("_domain").alias("domain"), "classifier", label.alias("predictedLabel"), "score")
