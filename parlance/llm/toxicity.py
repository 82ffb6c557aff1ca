"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features: densities of a fixed lexicon of insults and of a learned lexicon of
word beginnings, second-person words near insults, capitals, punctuation and
obfuscation.  Everything is learned from a bounded sample of labelled
documents (``sample_docs``): the learned lexicon by counting in how many toxic
and other documents a word beginning occurs, the trees (histogram splits on
the logistic loss) on features whose lexicon was learned without the
document's own fold, and the calibration on scores of trees trained without
it.  Scoring is one pass over whole texts.

Cases: null and empty texts have all features zero and get that point's score;
rows with equal ids are learned once and all scored; without labelled
documents of both kinds the score is the base rate (0 without any).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import hash_unit, stored

# Insults of four languages.
INSULTS = frozenset((
    "idiot idiots idiotic moron morons moronic stupid dumb loser losers scum trash garbage worthless pathetic "
    "disgusting clown clowns fool fools jerk jerks creep creeps freak ugly hate hateful vermin coward cowards liar "
    "idiota idiotas tonto imbécil estúpido estúpida basura asqueroso payaso inútil cobarde "
    "dumm dummkopf trottel abschaum müll wertlos ekelhaft versager feigling lügner "
    "idiote crétin débile stupide ordure déchet minable dégoûtant nul nulle lâche menteur"
).split())
# Second-person words of four languages.
SECOND_PERSON = frozenset("you your yours yourself ya du dich dir dein deine euch ihr tu te toi ton ta tes vous "
                          "votre vos tú ti tuyo usted ustedes vosotros".split())
# Digits and signs used for letters.
LEET = str.maketrans("013457@$!", "oieastasi")

WORDS = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_]+(?:[*@$!0-9][^\W\d_]*)+[^\W\d_]")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
FEATURES = ("insults", "any insult", "learned", "learned share", "near you", "you", "capitals", "capital words",
            "marks", "exclaims", "questions", "masked", "masked insults", "stretched", "log words")


@dataclass(frozen=True)
class ToxicityParams:
    """``sample_docs`` labelled documents and ``max_stems`` lexicon entries bound what is learned from."""

    sample_docs: int = 6000
    max_stems: int = 20_000
    stem_lengths: tuple[int, ...] = (4, 5, 6)
    min_docs: int = 4
    min_ratio: float = 6.0
    near: int = 3
    folds: int = 3
    trees: int = 60
    depth: int = 3
    bins: int = 32
    rate: float = 0.15
    min_leaf: int = 5
    seed: int = 3


class Lexicon(dict):
    """(insult, learned weight) by word; the words kept are bounded."""

    def __init__(self, weights: dict[str, float], p: ToxicityParams, limit: int = 300_000):
        super().__init__()
        self.weights, self.p, self.limit = weights, p, limit

    def __reduce__(self):
        return Lexicon, (self.weights, self.p, self.limit)

    def __missing__(self, word: str) -> tuple[bool, float]:
        found = [self.weights[word[:n]] for n in self.p.stem_lengths if len(word) >= n and word[:n] in self.weights]
        entry = (word in INSULTS, max(found, default=0.0))
        if len(self) >= self.limit:
            self.clear()
        self[word] = entry
        return entry


def features(text: str, lexicon: Lexicon) -> list[float]:
    """FEATURES of a whole text."""
    words = WORDS.findall(text.lower())
    n, n_chars = max(len(words), 1), max(len(text), 1)
    entries = list(map(lexicon.__getitem__, words))
    hits = [i for i, e in enumerate(entries) if e[0]]
    learned = [e[1] for e in entries if e[1]]
    yours = sum(map(SECOND_PERSON.__contains__, words))
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - lexicon.p.near):i + lexicon.p.near + 1]) for i in hits)
    masked = MASKED.findall(text)
    bad = sum(m.lower().translate(LEET) in INSULTS for m in masked)
    capitals = sum(map(str.isupper, text))
    loud = sum(len(w) > 1 and w.isupper() for w in text.split()) if capitals > 1 else 0
    return [100 * len(hits) / n, float(min(len(hits), 5)), 100 * sum(learned) / n, len(learned) / n, 100 * near / n,
            100 * yours / n, capitals / n_chars, loud / n, sum(map(text.count, ",.;:")) / n_chars,
            100 * text.count("!") / n_chars, 100 * text.count("?") / n_chars, len(masked) / n, 100 * bad / n,
            len(STRETCHED.findall(text)) / n, float(np.log1p(len(words)))]


# ---- what is learned -------------------------------------------------------------------------------------------

def fit_trees(x: np.ndarray, y: np.ndarray, p: ToxicityParams) -> tuple[float, list]:
    """(base score, trees): each tree a list of levels' (feature, threshold) arrays and its leaf values."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, p.bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    score, trees = np.full(len(y), base), []
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-6)
        node, levels = np.zeros(len(y), int), []
        for level in range(p.depth):
            n_nodes = 1 << level
            best = np.zeros(n_nodes)
            feature, threshold = np.zeros(n_nodes, int), np.full(n_nodes, np.inf)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                at, size = node * p.bins + binned[:, f], n_nodes * p.bins
                g, h, c = (np.bincount(at, w, size).reshape(n_nodes, p.bins).cumsum(1) for w in (grad, hess, None))
                total_g, total_h, total_c = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + 1) + (total_g - g)**2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                gain[(c < p.min_leaf) | (total_c - c < p.min_leaf)] = 0
                gain = gain[:, :len(e)]
                cut = gain.argmax(1)
                better = gain[np.arange(n_nodes), cut] > best + 1e-9
                best[better] = gain[np.arange(n_nodes), cut][better]
                feature[better], threshold[better] = f, e[cut][better]
            levels.append((feature, threshold))
            node = 2 * node + (x[np.arange(len(y)), feature[node]] > threshold[node])
        size = 1 << p.depth
        leaves = p.rate * np.bincount(node, grad, size) / (np.bincount(node, hess, size) + 1)
        score += leaves[node]
        trees.append((levels, leaves))
    return base, trees


def tree_scores(x: np.ndarray, model: tuple[float, list]) -> np.ndarray:
    base, trees = model
    out, every = np.full(len(x), base), np.arange(len(x))
    for levels, leaves in trees:
        node = np.zeros(len(x), int)
        for feature, threshold in levels:
            node = 2 * node + (x[every, feature[node]] > threshold[node])
        out += leaves[node]
    return out


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the isotonic regression of y on score (pool adjacent violators), for linear interpolation."""
    knots, first = np.unique(score, return_inverse=True)
    sums, counts = np.bincount(first, y), np.bincount(first)
    blocks: list[list[float]] = []  # sum, count, number of knots
    for s, c in zip(sums.tolist(), counts.tolist(), strict=True):
        blocks.append([s, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2] + n2]
    return knots, np.concatenate([np.full(int(n), s / c) for s, c, n in blocks])


@dataclass
class ToxicityModel:
    stems: dict[str, float]
    trees: tuple[float, list]
    knots: tuple[np.ndarray, np.ndarray]
    params: ToxicityParams
    lexicon: Lexicon | None = field(default=None, repr=False)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.lexicon is None:
            self.lexicon = Lexicon(self.stems, self.params)
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, len(FEATURES))
        return np.clip(np.interp(tree_scores(x, self.trees), *self.knots), 0, 1)


def _stems(text: str, p: ToxicityParams) -> set[str]:
    return {w[:n] for w in set(WORDS.findall(text.lower())) for n in p.stem_lengths if len(w) >= n}


def labelled_sample(docs: DataFrame, labels: DataFrame, may_learn: Column, p: ToxicityParams) -> DataFrame:
    """text, toxic, fold of the sample, stored: about ``sample_docs`` documents, picked by a hash of their id."""
    usable = labels.where(may_learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    n = usable.count()
    rate = min(1.0, p.sample_docs / max(n, 1))
    picked = (usable.where(hash_unit(F.col("doc_id"), F.lit(p.seed)) < rate)
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").limit(2 * p.sample_docs))  # ids only
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(p.seed + 1)), F.lit(p.folds)).cast("int")
    one = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return stored(one.select("doc_id", "text", "toxic", fold.alias("fold")), "toxic-sample")


def _stem_counts(rows: DataFrame, p: ToxicityParams, among: list[str] | None) -> list:
    """Documents by stem and fold; of all stems those of at least ``min_docs``, at most ``max_stems``."""
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(among) if among is not None else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stems, folds = [], []
            for text, fold in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = _stems(text.as_py(), p)
                found = found if shared.value is None else found & shared.value
                stems += found
                folds += [fold] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(folds, pa.int32())], ["stem", "fold"])

    by_fold = [F.count(F.when(F.col("fold") == k, 1)).alias(f"f{k}") for k in range(p.folds)]
    counts = rows.select("text", "fold").mapInArrow(run, "stem string, fold int").groupBy("stem").agg(
        F.count("*").alias("n"), *by_fold)
    if among is None:
        counts = counts.where(F.col("n") >= p.min_docs).orderBy(F.desc("n"), "stem").limit(p.max_stems)
    return counts.collect()


def _weights(toxic: dict, other: dict, n_toxic: list[int], n_other: list[int], skip: int | None,
             p: ToxicityParams) -> dict[str, float]:
    """Log odds of the stems that are clearly commoner in toxic documents, without the fold ``skip``."""
    folds = [k for k in range(p.folds) if k != skip]
    nt, no, out = sum(n_toxic[k] for k in folds), sum(n_other[k] for k in folds), {}
    for stem, counts in toxic.items():
        t, o = sum(counts[k] for k in folds), sum(other.get(stem, [0] * p.folds)[k] for k in folds)
        ratio = ((t + 0.5) / (nt + 1)) / ((o + 0.5) / (no + 1))
        if t >= p.min_docs - (skip is not None) and ratio >= p.min_ratio:
            out[stem] = float(np.log(ratio))
    return out


def train(sample: DataFrame, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Lexicon, trees and calibration from the sample; texts stay on the executors."""
    per = {(r["toxic"], r["fold"]): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    n_toxic, n_other = ([per.get((c, k), 0) for k in range(p.folds)] for c in (1, 0))
    if not sum(n_toxic) or not sum(n_other):
        share = float(bool(sum(n_toxic)))
        return ToxicityModel({}, (0.0, []), (np.zeros(1), np.full(1, share)), p)
    of = lambda r: [r[f"f{k}"] for k in range(p.folds)]
    toxic = {r["stem"]: of(r) for r in _stem_counts(sample.where("toxic = 1"), p, None)}
    other = {r["stem"]: of(r) for r in _stem_counts(sample.where("toxic = 0"), p, list(toxic))}
    stems = {k: _weights(toxic, other, n_toxic, n_other, k, p) for k in (*range(p.folds), None)}
    shared = sample.sparkSession.sparkContext.broadcast(stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = {k: Lexicon(w, p) for k, w in shared.value.items()}
        for batch in batches:
            x = [features(t.as_py(), lexicons[k]) for t, k in zip(batch.column(3), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.float64()))],
                                             ["doc_id", "toxic", "fold", "x"])

    rows = (sample.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "fold", "text")
            .mapInArrow(run, "doc_id long, toxic int, fold int, x array<double>").toPandas().sort_values("doc_id"))
    x, y, fold = np.array(rows["x"].tolist()), rows["toxic"].to_numpy("f8"), rows["fold"].to_numpy()
    unseen = np.zeros(len(y))
    for k in range(p.folds):
        if (fold == k).any() and (fold != k).any():
            unseen[fold == k] = tree_scores(x[fold == k], fit_trees(x[fold != k], y[fold != k], p))
    return ToxicityModel(stems[None], fit_trees(x, y, p), fit_isotonic(unseen, y), p)


def scored(docs: DataFrame, model: ToxicityModel, keep: Iterable[str] = (), threshold: float = 0.7,
           text: str = "text") -> DataFrame:
    """``keep`` columns plus score and predicted; no shuffle, the model is broadcast."""
    keep = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                score = shared.value.score(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score, pa.float64())], [*keep, "score"])

    return rows.mapInArrow(run, f"{kept}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
