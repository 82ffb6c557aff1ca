"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are the hashed byte n-grams of its lower-cased form; its
hidden vector is the mean of their embeddings, and a softmax over a linear map
of it gives the language.  Embeddings and map are trained by stochastic
gradient descent in numpy on a bounded sample of labelled documents
(``per_language`` documents of each language).  A held-back part of the sample
calibrates the scores by a temperature and sets the score below which a
prediction counts as rejected.  At prediction the embeddings are already
multiplied by the map, so a text costs one gather per n-gram.

Cases: null texts and texts without a letter are ``und`` with score 0 and
rejected; a null language is never learned; repeated rows are predicted
alike; without any labelled document every text is ``und``; more columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import hash_unit, stored


@dataclass(frozen=True)
class LangParams:
    """Bounds of what is learned from: documents of a language, languages, all documents, bytes of their features.

    The rest is the model's form.
    """

    per_language: int = 600
    max_languages: int = 200
    sample_docs: int = 24_000
    sample_bytes: int = 256 << 20
    buckets: int = 1 << 14
    orders: tuple[int, ...] = (2, 3, 4)
    dim: int = 16
    epochs: int = 8
    rate: float = 1.0
    seed: int = 1
    accepted_accuracy: float = 0.99


@dataclass(frozen=True)
class LangModel:
    languages: tuple[str, ...]
    table: np.ndarray  # (buckets, languages): embeddings times the map
    bias: np.ndarray
    temperature: float
    reject_below: float
    params: LangParams


def ngram_buckets(text: str, p: LangParams) -> Iterator[np.ndarray]:
    """Buckets of all byte n-grams of the text, in pieces of bounded size."""
    data = np.frombuffer(text.lower().encode(), "u1")
    step, shift = 1 << 18, np.uint32(32 - (p.buckets.bit_length() - 1))
    for at in range(0, max(len(data), 1), step):
        part = data[at:at + step + max(p.orders) - 1].astype("u4")
        for n in p.orders:
            m = min(len(part) - n + 1, step)
            if m > 0:
                h = np.full(m, n, "u4")
                for k in range(n):
                    h = h * np.uint32(0x01000193) + part[k:k + m]
                yield (h * np.uint32(0x9E3779B1)) >> shift


def features(text: str, p: LangParams) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their shares of the text's n-grams)."""
    counts = np.zeros(p.buckets)
    for h in ngram_buckets(text, p):
        counts += np.bincount(h, minlength=p.buckets)
    at = np.flatnonzero(counts)
    return at.astype("i4"), (counts[at] / max(counts.sum(), 1)).astype("f4")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``part`` (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, may_learn: Column, p: LangParams) -> list:
    """(lang, buckets, shares) rows of the sample, whole texts each.

    Documents are picked by a hash of id and text, with a rate per language
    from its count over all documents; features are made on the executors.
    What reaches the driver is bounded by ``sample_docs`` documents and
    ``sample_bytes`` of features, the first by that hash, so that the same
    documents stay on any partitioning.
    """
    eligible = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = (eligible.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
              .limit(p.max_languages).collect())
    if not counts:
        return []
    each = min(p.per_language, max(p.sample_docs // len(counts), 1))
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col("lang") == r["lang"], F.lit(each / r["n"])).otherwise(rate)
    pick = F.xxhash64("doc_id", F.xxhash64("text"), F.lit(p.seed))
    picked = (eligible.where(hash_unit(F.col("doc_id"), F.lit(p.seed)) < rate)
              .select("lang", pick.alias("pick"), "text").dropDuplicates(["lang", "pick"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py(), p) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in made], pa.binary()),
                 pa.array([b.tobytes() for _, b in made], pa.binary())], ["lang", "pick", "at", "share"])

    made = stored(picked.mapInArrow(run, "lang string, pick long, at binary, share binary"), "language-sample")
    sizes = (made.select("pick", (F.octet_length("at") + F.octet_length("share")).alias("size"))
             .orderBy("pick").limit(2 * p.sample_docs).collect())
    fits = np.cumsum([r["size"] for r in sizes]) <= p.sample_bytes
    if not fits.any():
        return []
    rows = made.where(F.col("pick") <= sizes[int(fits.sum()) - 1]["pick"]).collect()
    # an order of its own, so that the model does not depend on the partitioning
    rows.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["share"])))
    return [(r["lang"], np.frombuffer(r["at"], "i4"), np.frombuffer(r["share"], "f4")) for r in rows]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(sample: list, p: LangParams) -> LangModel:
    """SGD over four fifths of the sample; temperature and rejection on the rest."""
    languages = tuple(sorted({lang for lang, _, _ in sample}))
    rng = np.random.default_rng(p.seed)
    table, bias = np.zeros((p.buckets, len(languages))), np.zeros(len(languages))
    if not sample:
        return LangModel(languages, table.astype("f4"), bias, 1.0, 1.0, p)
    label = np.array([languages.index(lang) for lang, _, _ in sample])
    order = rng.permutation(len(sample))
    n_check = len(sample) // 5
    check, learn = order[:n_check], order[n_check:]
    embed = rng.normal(0, 1 / p.dim, (p.buckets, p.dim))
    to_lang = np.zeros((p.dim, len(languages)))
    steps, total = 0, p.epochs * len(learn)
    for _ in range(p.epochs):
        for i in rng.permutation(learn):
            _, at, share = sample[i]
            rate = p.rate * (1 - steps / total)
            steps += 1
            hidden = share @ embed[at]
            slope = _softmax(hidden @ to_lang + bias)
            slope[label[i]] -= 1
            back = to_lang @ slope
            to_lang -= rate * np.outer(hidden, slope)
            bias -= rate * slope
            embed[at] -= rate * len(at) ** 0.5 * share[:, None] * back
    table = embed @ to_lang
    if not n_check:
        return LangModel(languages, table.astype("f4"), bias, 1.0, 0.0, p)
    scores = np.array([sample[i][2] @ table[sample[i][1]] + bias for i in check])
    truth = label[check]

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(scores / t)[np.arange(n_check), truth], 1e-12)).mean()

    temperature = min(np.geomspace(0.05, 20, 61), key=loss)
    best = _softmax(scores / temperature).max(1)
    right = scores.argmax(1) == truth
    reject = 0.0
    for s in np.sort(best):  # the least score at which what is accepted is right often enough
        if right[best >= s].mean() >= p.accepted_accuracy:
            reject = float(s)
            break
    return LangModel(languages, table.astype("f4"), bias, float(temperature), reject, p)


def predict(text: str | None, m: LangModel) -> tuple[str, float, bool]:
    """(language, score, rejected)."""
    if not m.languages or text is None or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    total, n = np.zeros(len(m.languages)), 0
    for h in ngram_buckets(text, m.params):
        total += m.table[h].sum(0, dtype="f8")
        n += len(h)
    score = _softmax((total / max(n, 1) + m.bias) / m.temperature)
    best = int(score.argmax())
    return m.languages[best], float(score[best]), bool(score[best] < m.reject_below)


def predicted(docs: DataFrame, model: LangModel, keep: Iterable[str] = (), text: str = "text") -> DataFrame:
    """``keep`` columns plus lang_pred, score, rejected; no shuffle, the model is broadcast."""
    keep = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(t.as_py(), shared.value) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                [*keep, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double, rejected boolean")
