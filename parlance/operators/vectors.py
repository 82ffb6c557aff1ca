"""Hashed bigram vectors (E3) a block of texts at a time.

The tokens of a text stand one white-space character apart, so a bigram is the
run of bytes from the start of one token to the end of the next, and there is
one per separator: neither tokens nor bigrams are made as strings.  Their
buckets are those of the SQL form, ``pmod(hash(bigram), width)``, which the
saved pipelines and ``features.hashed_tf`` use.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_BYTES = 1 << 18  # bytes of text hashed at once, or one longer text
_SEED = 42  # of Spark's hash()
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\f\r")] = True
_VECTOR = pa.struct([pa.field("type", pa.int8(), nullable=False), pa.field("size", pa.int32()),
                     pa.field("indices", pa.list_(pa.int32())), pa.field("values", pa.list_(pa.float64()))])


def _mixed(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """One Murmur3 round of the hashes ``h`` with the words ``k`` (unsigned 32-bit)."""
    k = k * np.uint32(0xCC9E2D51)
    k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593) ^ h
    return (k << np.uint32(13) | k >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spark's ``hash`` (signed 32-bit) of the byte runs ``data[begin:end]``."""
    length = end - begin
    order = np.argsort(-length, kind="stable")  # the runs that still have words come first
    at, size = begin[order], length[order]
    words = size >> 2
    padded = np.concatenate([data, np.zeros(4, "u1")]).astype("u4")
    every = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)
    h = np.full(len(at), _SEED, "u4")
    fewer = -words
    for w in range(int(words[0]) if len(words) else 0):
        n = int(np.searchsorted(fewer, -w))  # runs of more than w words
        h[:n] = _mixed(h[:n], every[at[:n] + 4 * w])
    for t in range(3):  # what is left, a signed byte at a time
        on = np.flatnonzero((size & 3) > t)
        h[on] = _mixed(h[on], data[at[on] + 4 * words[on] + t].view("i1").astype("i4").view("u4"))
    h ^= size.astype("u4")
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    out = np.empty(len(h), "i4")
    out[order] = (h ^ h >> np.uint32(16)).view("i4")
    return out


def bigrams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the bigrams of the texts ``data[starts[i]:starts[i + 1]]``; trailing empty tokens do not count."""
    space = _SPACE[data]
    inked = np.flatnonzero(~space)
    last = np.searchsorted(inked, starts[1:]) - 1  # the last character of a token at or before each text's end
    ends = np.where(last >= 0, inked[np.maximum(last, 0)] + 1 if len(inked) else 0, 0)
    cuts = np.flatnonzero(space)
    text = np.searchsorted(starts, cuts, "right") - 1
    inner = cuts < ends[text]  # white space at a text's end cuts nothing off
    cuts, text = cuts[inner], text[inner]
    same = text[1:] == text[:-1]
    begin, end = starts[text], ends[text]
    begin[1:][same] = cuts[:-1][same] + 1
    end[:-1][same] = cuts[1:][same]
    return text, begin, end


def counts(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row pointers, buckets ascending in a row, counts) of lower-cased texts; none for null."""
    n = len(texts)
    starts = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset:texts.offset + n + 1].astype("i8") if n else np.zeros(1, "i8")
    held = texts.buffers()[2] if n else None
    data = np.frombuffer(held, "u1") if held is not None else np.zeros(0, "u1")
    lengths, buckets, found = np.zeros(n, "i8"), [], []
    row = 0
    while row < n:
        upto = max(row + 1, int(np.searchsorted(starts, starts[row] + _BYTES, "right")) - 1)
        part = data[starts[row]:starts[upto]]
        text, begin, end = bigrams(part, starts[row:upto + 1] - starts[row])
        bucket = hashes(np.where(_SPACE[part], np.uint8(32), part), begin, end) % np.int32(width)
        key, times = np.unique(text * width + bucket, return_counts=True)
        lengths[row:upto] = np.bincount(key // width, minlength=upto - row)
        buckets.append((key % width).astype("i4"))
        found.append(times.astype("f8"))
        row = upto
    return (np.concatenate([[0], np.cumsum(lengths)]), np.concatenate(buckets) if buckets else np.zeros(0, "i4"),
            np.concatenate(found) if found else np.zeros(0))


def _vectors(texts: pa.Array, width: int) -> pa.StructArray:
    pointers, buckets, found = counts(texts, width)
    n, at = len(texts), pa.array(pointers, pa.int32())
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(n, "i1")), pa.array(np.full(n, width, "i4")), pa.ListArray.from_arrays(at, pa.array(buckets)),
         pa.ListArray.from_arrays(at, pa.array(found))], fields=list(_VECTOR))


def hashed_vectors(df: DataFrame, text_for: Mapping[str, str], width: int) -> DataFrame:
    """Adds to ``df`` the vector columns named in ``text_for``: hashed bigram counts of the text column each reads.

    The vectors are those of ``train.text_feature_stages``.  Lower-casing stays with Spark.
    """
    kept, made = len(df.columns), list(text_for)
    given = df.select(*df.columns, *[F.lower(F.col(f"`{text_for[v]}`")).alias(f"_low_{v}") for v in made])
    schema = StructType([*df.schema.fields, *[StructField(v, VectorUDT()) for v in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [_vectors(batch.column(kept + i).cast(pa.string()), width) for i in range(len(made))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *vectors], [*batch.schema.names[:kept], *made])

    return given.mapInArrow(run, schema)
