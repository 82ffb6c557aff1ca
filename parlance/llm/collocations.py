"""Phrase collocations by Rabin-Karp fingerprints.

A chunk of documents is one array of bytes.  Words are put next to each other
with one blank between, and prefix polynomials modulo 2 ** 64 are summed over the
array, so the fingerprint of any n-gram is a difference of two prefixes, for all
n-grams at once.  What is shuffled is fingerprints and counts, level by level:
an n-gram can be frequent only if both (n-1)-grams in it are, so each level
counts only n-grams whose parts are marked in a bitmap of the level before.
The bitmaps have a fixed size (bitmaps.py) and err only towards counting more.

The last pass finds the occurrences of marked n-grams again, and here every
occurrence is held against the text: within a chunk the n-grams of one
fingerprint are compared byte by byte with the first one's bytes, at the
place its pointer names, and those that differ are counted by themselves.
Only here phrases are materialised, with the least document id of an
occurrence as pointer, and counts are summed per phrase, so colliding
fingerprints never share a count.

Scores are exact: products are decimals and the quotient is a whole-number
division (counts up to 10 ** 15).

Cases: a null text counts as empty; a null language is ``und``; pieces end at
punctuation, line ends and documents, and no phrase crosses one; very long
pieces are cut into parts that overlap by the words of a phrase, so memory does
not grow with a document; repeated rows count each time; an empty table gives
no rows; more columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.bitmaps import BITS, bitmap, marked
from parlance.llm.common import join_by_key, stored

# Bytes that end a piece, and those that end a word only.
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_BLANKS = b"\x20\x09"
_KIND = np.zeros(256, "u1")  # 0 in a word, 1 blank, 2 end of a piece
_KIND[list(_BLANKS)] = 1
_KIND[list(_BREAKS)] = 2
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_NO_WORD = np.uint8(32)
_BASE = 0x5851F42D4C957F2D  # of the polynomials modulo 2 ** 64; odd, so it has an inverse
RANGES = 8  # ranges of keys for every shuffle partition


@dataclass(frozen=True)
class PhraseParams:
    """Longest phrase, least count, percent of a longer phrase that hides one, phrases a language; sizes."""

    words: int = 3
    least: int = 10
    hidden: int = 50
    top: int = 2000
    bits: int = BITS
    fingerprint_bits: int = 40  # more for more n-grams: those that share one only make the marks less selective
    chunk: int = 1 << 21  # bytes hashed at once
    held: int = 1 << 20  # counts that a task holds before it lets them go


def language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def cut(data: bytes, size: int, words: int) -> list[tuple[int, int, int]]:
    """(begin, end, seen end) of parts of a text: n-grams that begin in a part lie within its seen end.

    Parts end after a piece's or a word's end; a part sees ``words`` - 1 words beyond its end, unless its piece ends.
    """
    if len(data) <= size:
        return [(0, len(data), len(data))]
    kind = _KIND[np.frombuffer(data, "u1")]
    starts = np.flatnonzero((kind == 0) & np.concatenate([[True], kind[:-1] != 0]))
    begin, out = 0, []
    while begin < len(data):
        at = np.searchsorted(starts, begin + size)
        if at < len(starts) and starts[at] > begin:
            end = int(starts[at])
            seen = int(starts[at + words - 1]) if at + words - 1 < len(starts) else len(data)
        else:
            end = seen = len(data)
        out.append((begin, end, seen))
        begin = end
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads the low bits, of which a polynomial's are weak."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_POWERS: dict = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of the base modulo 2 ** 64, kept per worker and made longer by doubling."""
    power = _POWERS.get(base)
    if power is None:
        power = np.ones(1, "u8")
    while len(power) < n:
        power = np.concatenate([power, power * np.uint64(pow(base, len(power), 1 << 64))])
    _POWERS[base] = power
    return power[:n]


class Chunk:
    """Words and n-gram fingerprints of some texts."""

    def __init__(self, texts: list[bytes], ends: list[int], langs: list[str], ids: list, params: PhraseParams):
        """``ends``: n-grams of a text begin before this offset."""
        import xxhash
        data = np.frombuffer(b"\n".join(texts) + b"\n", "u1")
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        kind = _KIND[data]
        in_word = kind == 0
        after = np.empty(len(data), bool)  # whether the byte before is of a word
        after[0], after[1:] = False, in_word[:-1]
        starts = np.flatnonzero(in_word & ~after)
        self.piece = np.cumsum(kind == 2, dtype="i4")[starts]
        self.owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, [*begins, len(data)])))
        self.counted = starts < (begins + np.array(ends))[self.owner]  # begins in its text's own part
        keep = in_word | after
        lower = _LOWER[data]
        lower[~in_word] = _NO_WORD
        self.bytes = lower[keep]
        self.end = np.flatnonzero(~in_word[keep])  # the blank after each word
        self.begin = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else self.end
        self.langs, self.ids = langs, ids
        salts = {lang: xxhash.xxh3_64_intdigest(lang) for lang in set(langs)}
        self.salt = np.array([salts[lang] for lang in langs], "u8")[self.owner]
        self.mask = np.uint64((1 << params.fingerprint_bits) - 1)
        n = len(self.bytes)
        self.sums = np.zeros(n + 1, "u8")
        np.cumsum(self.bytes * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 1 << 64), n)[self.begin]  # moves an n-gram's sum to the array's beginning
        self._keys: dict[int, np.ndarray] = {}

    def spans(self, n: int) -> np.ndarray:
        """Places of the words that begin an n-gram."""
        last = len(self.begin) - n + 1
        if last <= 0:
            return np.empty(0, "i8")
        return np.flatnonzero(self.counted[:last] & (self.piece[:last] == self.piece[n - 1:n - 1 + last]))

    def keys(self, n: int) -> np.ndarray:
        """Fingerprints of the n words from every place on (also across pieces), told apart by language."""
        if n not in self._keys:
            last = max(len(self.begin) - n + 1, 0)
            value = (self.sums[self.end[n - 1:]] - self.sums[self.begin[:last]]) * self.back[:last]
            self._keys[n] = (_mixed(value ^ self.salt[:last]) & self.mask).astype("i8")
        return self._keys[n]

    def frequent(self, n: int, marks: list[np.ndarray]) -> np.ndarray:
        """Places of the n-grams of which every part, and with a bitmap for n itself they, too, are marked.

        ``marks`` has bitmaps by length, from 1.
        """
        at = self.spans(n)
        if n > 1 and len(marks) >= n - 1:
            good = marked(marks[n - 2], self.keys(n - 1))
            at = at[good[at] & good[at + 1]]
        if len(marks) >= n:
            at = at[marked(marks[n - 1], self.keys(n)[at])]
        return at


def chunked(batches: Iterator[pa.RecordBatch], params: PhraseParams) -> Iterator[Chunk]:
    """Chunks of batches of (text, lang, doc_id)."""
    texts, ends, langs, ids, size = [], [], [], [], 0
    for batch in batches:
        for t, lang, doc_id in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                   strict=True):
            data = t.as_buffer().to_pybytes()
            for begin, end, seen in cut(data, params.chunk, params.words):
                if size and size + seen - begin > params.chunk:
                    yield Chunk(texts, ends, langs, ids, params)
                    texts, ends, langs, ids, size = [], [], [], [], 0
                texts.append(data[begin:seen])
                ends.append(end - begin)
                langs.append(lang)
                ids.append(doc_id)
                size += seen - begin + 1
    if texts:
        yield Chunk(texts, ends, langs, ids, params)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, with their counts added."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    if not len(key):
        return key, count
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


class Held:
    """Keys and counts that are added up as they come."""

    def __init__(self, limit: int):
        self.limit, self.keys, self.counts, self.size = limit, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > 2 * self.limit:
            self.take(keep=True)

    def take(self, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All distinct keys and their counts; lets them go unless ``keep``."""
        got = summed(self.keys, self.counts) if self.keys else (np.empty(0, "i8"), np.empty(0, "i8"))
        self.keys, self.counts = ([got[0]], [got[1]]) if keep else ([], [])
        self.size = len(got[0]) if keep else 0
        return got


def frequent_keys(docs: DataFrame, n: int, marks: list, params: PhraseParams) -> DataFrame:
    """{words, key}: fingerprints of the n-grams, all parts of which are marked, that come at least ``least`` times
    (``words`` n); with n = 3 also those of the words in marked bigrams (``words`` 1).

    A task adds up its counts and sends them as packed runs of keys by range
    of keys; ranges are shuffled and added by streaming over their runs.  Keys
    are uniform numbers and come once per task and run, so no range is hot;
    there are RANGES of them for every shuffle partition.
    """
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = [(r << params.fingerprint_bits) // ranges for r in range(ranges + 1)]
    small = "<u4" if max(b - a for a, b in zip(edges, edges[1:], strict=False)) <= 1 << 32 else "<u8"  # places in a range

    def packed(keys: np.ndarray, counts: np.ndarray, first: int) -> pa.RecordBatch:
        at = np.searchsorted(keys, edges)
        on = np.flatnonzero(np.diff(at)).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([first + r for r in on], pa.int32()),
             pa.array([(keys[at[r]:at[r + 1]] - edges[r]).astype(small).tobytes() for r in on], pa.binary()),
             pa.array([counts[at[r]:at[r + 1]].tobytes() for r in on], pa.binary())], ["range", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = Held(params.held), [m.value for m in marks]
        used = Held(params.held)
        for chunk in chunked(batches, params):
            keys, counts = np.unique(chunk.keys(n)[chunk.frequent(n, of)], return_counts=True)
            held.add(keys, counts.astype("i8"))
            if held.size > params.held:
                yield packed(*held.take(), 0)
            if n == 3:
                at = chunk.frequent(2, of)
                keys = np.unique(chunk.keys(1)[np.concatenate([at, at + 1])])
                used.add(keys, np.full(len(keys), params.least, "i8"))
                if used.size > params.held:
                    yield packed(*used.take(), ranges)
        if held.size:
            yield packed(*held.take(), 0)
        if used.size:
            yield packed(*used.take(), ranges)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = Held(params.held), None

        def out() -> pa.RecordBatch:
            keys, counts = held.take()
            keys = keys[counts >= params.least]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), n if now < ranges else 1), pa.int32()),
                                               pa.array(keys)], ["words", "key"])

        for batch in batches:
            for r, k, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if r != now and now is not None:
                    yield out()
                now = r
                held.add(np.frombuffer(k.as_buffer(), small).astype("i8") + edges[r % ranges],
                         np.frombuffer(c.as_buffer(), "<i8"))
        if now is not None:
            yield out()

    runs = docs.mapInArrow(count, "range int, keys binary, counts binary")
    return runs.repartition("range").sortWithinPartitions("range").mapInArrow(add, "words int, key long")


def differing(chunk: Chunk, at: np.ndarray, first: np.ndarray, n: int, lang_of: np.ndarray) -> np.ndarray:
    """Whether each n-gram's bytes or language differ from those of the n-gram at ``first``."""
    begin, length = chunk.begin[at], chunk.end[at + n - 1] - chunk.begin[at]
    other = chunk.begin[first]
    out = (length != chunk.end[first + n - 1] - other) | (lang_of[chunk.owner[at]] != lang_of[chunk.owner[first]])
    for lo in range(0, len(at), 1 << 16):
        on = lo + np.flatnonzero(~out[lo:lo + (1 << 16)])
        if len(on):
            run = length[on]
            stops = np.cumsum(run)
            step = np.arange(stops[-1]) - np.repeat(stops - run, run)
            unlike = chunk.bytes[np.repeat(begin[on], run) + step] != chunk.bytes[np.repeat(other[on], run) + step]
            out[on] = np.logical_or.reduceat(unlike, stops - run)
    return out


def _texts(chunk: Chunk, at: np.ndarray, n: int) -> pa.Array:
    """The n-grams' texts."""
    begin, length = chunk.begin[at], chunk.end[at + n - 1] - chunk.begin[at]
    stops = np.cumsum(length)
    place = np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - length, length) + np.repeat(begin, length)
    offsets = np.concatenate([[0], stops]).astype("i4")
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(chunk.bytes[place])])


def phrase_counts(docs: DataFrame, marks: list, params: PhraseParams) -> DataFrame:
    """(lang, words, phrase, count, first_doc) of all n-grams marked at every level; words 0: all words of a language."""
    names = ["lang", "words", "phrase", "count", "first_doc"]
    none = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = [m.value for m in marks]
        totals: dict[str, int] = {}
        for chunk in chunked(batches, params):
            number = {lang: i for i, lang in enumerate(dict.fromkeys(chunk.langs))}
            langs, lang_of = pa.array(list(number), pa.string()), np.array([number[lang] for lang in chunk.langs])
            for lang, c in zip(number, np.bincount(lang_of[chunk.owner[chunk.spans(1)]], minlength=len(number)).tolist(), strict=True):
                totals[lang] = totals.get(lang, 0) + c
            ids = np.array([none if d is None else d for d in chunk.ids])
            for n in range(1, params.words + 1):
                at = chunk.frequent(n, of)
                if not len(at):
                    continue
                _, place, inverse, count = np.unique(chunk.keys(n)[at], return_index=True, return_inverse=True,
                                                     return_counts=True)
                bad = differing(chunk, at, at[place][inverse], n, lang_of)
                if bad.any():  # colliding fingerprints: these count by themselves
                    count -= np.bincount(inverse[bad], minlength=len(count))
                docs_of = ids[chunk.owner[at]]
                least = np.full(len(place), none)
                np.minimum.at(least, inverse[~bad], docs_of[~bad])
                out = np.concatenate([at[place], at[bad]])
                first = np.concatenate([least, docs_of[bad]])
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(lang_of[chunk.owner[out]])), pa.array(np.full(len(out), n), pa.int32()),
                     _texts(chunk, out, n), pa.array(np.concatenate([count, np.ones(int(bad.sum()), "i8")])),
                     pa.array(first, mask=first == none)], names)
        totals = {lang: c for lang, c in totals.items() if c}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.array([0] * len(totals), pa.int32()),
             pa.array([""] * len(totals), pa.string()), pa.array(list(totals.values()), pa.int64()),
             pa.array([None] * len(totals), pa.int64())], names)

    parts = docs.mapInArrow(run, "lang string, words int, phrase string, count long, first_doc long")
    return parts.groupBy("lang", "words", "phrase").agg(F.sum("count").alias("count"), F.min("first_doc").alias("first_doc"))


def frequent_phrases(docs: DataFrame, params: PhraseParams = PhraseParams(), text: str = "text", lang: str = "lang",
                     doc_id: str = "doc_id") -> DataFrame:
    """(lang, words, phrase, count, first_doc) of all phrases of 2 to ``words`` words that are frequent in a language, and
    of the words in them.

    The row with words 0 has the number of all words of its language.
    """
    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
                       language(F.col(f"`{lang}`")).alias("lang"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"))
    marks = []
    for n in range(1, params.words + 1):
        often = stored(frequent_keys(rows, n, marks, params), "frequent-keys")
        for words in (1, n) if n == 3 else (n,):  # of words, only those in a frequent bigram are asked for from here on
            marked_now = docs.sparkSession.sparkContext.broadcast(
                bitmap(often.where(F.col("words") == words), F.col("key"), params.bits))
            marks[words - 1:words] = [marked_now]
    counted = phrase_counts(rows, marks, params)
    return stored(counted.where((F.col("count") >= params.least) | (F.col("words") == 0)), "phrases")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact."""
    wide = lambda c: c.cast("decimal(18,0)")
    over = (F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a)).cast("decimal(38,0)")
    under = (wide(left) * wide(right)).cast("decimal(38,0)")
    return F.call_function("div", over, under)


def scored_phrases(phrases: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, first_doc: the first ``top`` phrases of each language.

    All parts of a frequent phrase are frequent, so counts of parts are joined from the same table.
    """
    several = phrases.where("words > 1")
    word = F.split("phrase", " ")
    cuts = F.array(*[F.when(F.col("words") > k, F.struct(
        F.lit(k).alias("k"), F.array_join(F.slice(word, 1, k), " ").alias("left"),
        F.array_join(F.slice(word, k + 1, params.words), " ").alias("right"))) for k in range(1, params.words)])
    cut_rows = several.select("lang", "words", "phrase", F.col("count").alias("a"), "first_doc",
                              F.inline(F.filter(cuts, lambda c: c.isNotNull())))
    key = lambda c: F.struct("lang", F.col(c).alias("phrase"))
    counts = phrases.where("words > 0").select(F.struct("lang", "phrase").alias("part"), F.col("count").alias("f"))
    heavy = max(1, several.count() // 100)

    def with_count(rows: DataFrame, side: str, name: str) -> DataFrame:
        asked = rows.withColumn("part", key(side))
        need = asked.groupBy("part").agg(F.count("*").alias("m")).join(counts, "part")
        return join_by_key(asked, need, "part", heavy, "m").drop("part", "m").withColumnRenamed("f", name)

    parts = stored(with_count(with_count(cut_rows, "left", "l"), "right", "r"), "cuts")
    parts = parts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")).cast("long"))
    lowest = parts.groupBy("lang", "words", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("s"), F.first("a").alias("a"), F.first("first_doc").alias("first_doc"))

    def within(n: int) -> DataFrame:
        """The phrases of n words inside the longer ones."""
        inside = F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(word, i, n), " "))
        return several.where(F.col("words") > n).select("lang", F.explode(F.array_distinct(inside)).alias("phrase"),
                                                        F.col("count").alias("most"))

    longer = [within(n) for n in range(2, params.words)]
    if longer:
        hiding = longer[0]
        for more in longer[1:]:
            hiding = hiding.union(more)
        hiding = hiding.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
        lowest = lowest.join(hiding, ["lang", "phrase"], "left").where(
            F.col("most").isNull() | (100 * F.col("most") < params.hidden * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (lowest.select("lang", "phrase", "a", "s.l", "s.r", "s.score", "first_doc")
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.top))
    totals = phrases.where("words = 0").select("lang", F.col("count").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                              "n", "score", "first_doc")


def collocations(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """The phrases of each language whose words stick together most."""
    return scored_phrases(frequent_phrases(docs, params), params)
