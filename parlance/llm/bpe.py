"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are a linked list of byte strings.  Every adjacent pair whose
concatenation is a token waits, by its left position, in the bucket of that
token's rank.  A two-level bitmap over the ranks marks the buckets in use, so
find-first-set gives the lowest pending rank without a search, however long
the pre-tokens are.  An entry is stale, and skipped, if the pair at its position
has changed since it was put in.  Within a rank the leftmost pair goes first.
One queue serves many pre-tokens at once: no pair reaches over the end of one,
so each is merged as it would be alone, and a bucket is found once for all.

Texts are cut into chunks (a word with its leading blank, or a line feed)
whose tokens do not depend on their neighbours, so each distinct chunk is
merged once per worker and cached; the cache is emptied when full, so memory
is bounded.  The chunks that a group of texts has and the cache has not are
merged together.  Texts with other white space are cut by the pattern as a
whole.

Cases: a null text counts as empty and has no tokens; repeated rows are
encoded alike; invalid surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Collection, Iterable, Iterator
from heapq import heappop, heappush
from itertools import filterfalse, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space other than blank and line feed, and the mark that parts are cut at.
_ODD_BLANKS = "\t\v\f\r\x1c\x1d\x1e\x1f\0"
WIDE_BLANKS = ("\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029"
               "\u202f\u205f\u3000")
_PAIRED = ("  ", " \n", "\n ", "\n\n")
# Bytes of pre-tokens in one queue, and characters of texts encoded together; either may be passed by
# the last one put in.
_QUEUE_BYTES = 1 << 14
_GROUP_CHARS = 1 << 18


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token of a tiktoken vocabulary file (base64 token, blank, rank)."""
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in data.splitlines() if x)}


class Merger:
    """The rank queue of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        none: dict[int, int] = {}
        # Rank of the concatenation by left rank and right rank, for every split of every token; no token (-1) has pairs.
        self.pairs = [none] * (size + 1)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    if self.pairs[left] is none:
                        self.pairs[left] = {}
                    self.pairs[left][right] = rank
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)])
        self.of_two = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.n_words = (size >> 8) + 1

    def merge(self, pieces: Collection[bytes]) -> list[bytes]:
        """Token ids (little-endian unsigned 32-bit) of each pre-token; none may be a token as it is.

        The lowest rank merges first, leftmost first within a rank.
        """
        if not pieces:
            return []
        data = np.frombuffer(b"\0".join(pieces) + b"\0", "u1")
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1  # a place without token after each pre-token
        tokens = self.of_byte[data]
        tokens[ends] = -1
        firsts = np.full(len(data), -1)
        firsts[:-1] = self.of_two[data[:-1].astype("i4") << 8 | data[1:]]
        firsts[ends] = firsts[ends - 1] = -1
        token = tokens.tolist()  # -1 once merged into its left neighbour
        after, before = list(range(1, len(data) + 1)), list(range(-1, len(data) - 1))
        waiting = firsts.tolist()  # rank under which the pair at a position waits
        order = np.argsort(firsts, kind="stable")
        order = order[np.count_nonzero(firsts < 0):]
        places = order.tolist()
        ranks = firsts[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        buckets = {r: places[a:b] for r, (a, b) in zip(ranks[starts].tolist(), pairwise([*starts.tolist(), len(places)]))}
        heaps: set[int] = set()  # ranks whose buckets are heaps
        words = [0] * self.n_words  # bitmap words: one bit per rank in use
        top = 0  # one bit per word in use
        for rank in buckets:
            words[rank >> 8] |= 1 << (rank & 255)
            top |= 1 << (rank >> 8)
        pairs, bucket_of = self.pairs, buckets.get
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            rank = (w << 8) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if rank in heaps:
                places = [heappop(bucket)]
            else:
                places = sorted(bucket)
                bucket.clear()
            of_left = pairs[rank].get
            for at in places:
                if waiting[at] != rank:  # stale
                    continue
                gone, left = after[at], before[at]
                right = after[at] = after[gone]
                before[right] = at
                token[at], token[gone], waiting[gone] = rank, -1, -1
                # The pairs at these two positions are new and go into their buckets.
                low = rank
                new = waiting[at] = of_left(token[right], -1)
                if new >= 0:
                    found = bucket_of(new)
                    if found is None:
                        buckets[new] = [at]
                        words[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
                    elif new in heaps:
                        heappush(found, at)
                    else:
                        found.append(at)
                    if new < rank:
                        low = new
                new = waiting[left] = pairs[token[left]].get(rank, -1)
                if new >= 0:
                    found = bucket_of(new)
                    if found is None:
                        buckets[new] = [left]
                        words[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
                    elif new in heaps:
                        heappush(found, left)
                    else:
                        found.append(left)
                    if new < rank:
                        low = new
                if low < rank and rank not in heaps:  # it goes first: the others wait again, from now on as a heap
                    heaps.add(rank)
                    bucket += [p for p in places if waiting[p] == rank]
                    break
            if not bucket:
                del buckets[rank]
                words[w] ^= 1 << (rank & 255)
                if not words[w]:
                    top ^= 1 << w
        merged = np.array(token)
        kept = merged >= 0
        upto = (4 * np.cumsum(kept)[ends]).tolist()
        ids = merged[kept].astype("<u4").tobytes()
        return [ids[a:b] for a, b in pairwise([0, *upto])]


def chunks(text: str, pattern: regex.Pattern) -> list[str]:
    """The text in parts that are tokenized independently of each other.

    Where the only white space is single blanks and line feeds between other
    characters, a part is a line feed or a word with the blank before it;
    otherwise the parts are the pattern's matches.
    """
    if not text:
        return []
    has = text.__contains__
    if (text[0].isspace() or text[-1].isspace() or any(map(has, _PAIRED)) or any(map(has, _ODD_BLANKS))
            or not text.isascii() and any(map(has, WIDE_BLANKS))):
        return pattern.findall(text)
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


class ChunkIds(dict):
    """Token ids (little-endian unsigned 32-bit) by chunk.

    Two generations: when the young one has ``limit`` chunks it becomes the
    old one, and a chunk found there moves to the young one.  Chunks of more
    than ``longest`` characters are kept only for the group of texts at hand.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 350_000, longest: int = 64):
        super().__init__()
        self.ranks, self.merger, self.pattern = ranks, Merger(ranks), regex.compile(pattern)
        self.old: dict[str, bytes] = {}
        self.passing: set[str] = set()  # long chunks of the group of texts at hand
        self.limit, self.longest = limit, longest

    def learn(self, wanted: Iterable[str]) -> None:
        """Have the ids of all ``wanted`` chunks in the young generation."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        split = {}
        for chunk in filterfalse(self.__contains__, wanted):
            ids = self.old.get(chunk)
            if ids is None:
                split[chunk] = self.pattern.findall(chunk)
            else:
                self[chunk] = ids
        self.learn_pieces({p for pieces in split.values() for p in pieces if p not in self})
        for chunk, pieces in split.items():
            if len(pieces) > 1:
                self[chunk] = b"".join([self[p] for p in pieces])
            if len(chunk) > self.longest:
                self.passing.update(p for p in (chunk, *pieces) if len(p) > self.longest)

    def learn_pieces(self, pieces: Iterable[str]) -> None:
        """Merge pre-tokens that are not known, in queues of bounded size."""
        waiting, size = {}, 0
        for piece in pieces:
            ids = self.old.get(piece)
            if ids is None:
                data = piece.encode()
                rank = self.ranks.get(data)
                if rank is None:
                    waiting[piece] = data
                    size += len(data)
                    if size >= _QUEUE_BYTES:
                        self.update(zip(waiting, self.merger.merge(waiting.values())))
                        waiting, size = {}, 0
                    continue
                ids = rank.to_bytes(4, "little")
            self[piece] = ids
        self.update(zip(waiting, self.merger.merge(waiting.values())))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; what the texts have and the cache has not is merged together."""
        parts = [chunks(text, self.pattern) for text in texts]
        self.learn(set().union(*parts))
        out = [b"".join(map(self.__getitem__, p)) for p in parts]
        for chunk in self.passing:
            del self[chunk]
        self.passing.clear()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


class Decoder:
    """Bytes of ids: one gather over the vocabulary's bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = tokens

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


def grouped(texts: pa.Array, chars: int) -> Iterator[list[str]]:
    """The texts in order, in groups of ``chars`` characters or somewhat more; the last may have fewer."""
    group, size = [], 0
    for value in texts:
        group.append(value.as_py())
        size += len(group[-1])
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


_ENCODERS: dict = {}


def worker_encoder(data: bytes, pattern: str) -> tuple[ChunkIds, Decoder]:
    """One encoder and its inverse vocabulary per Python worker, kept between tasks."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _ENCODERS:
        ranks = load_ranks(data)
        _ENCODERS[key] = ChunkIds(ranks, pattern), Decoder(ranks)
    return _ENCODERS[key]


def encoded(docs: DataFrame, vocabulary_path: str, pattern: str, keep: Iterable[str] = (), text: str = "text",
            with_ids: bool = False) -> DataFrame:
    """``keep`` columns plus n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids as an array.

    The vocabulary (its size does not depend on the data) is read on the
    driver and broadcast; no shuffle.
    """
    with open(vocabulary_path, "rb") as f:
        data = f.read()
    vocabulary = docs.sparkSession.sparkContext.broadcast(data)
    keep = list(keep)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    fields = rows.drop("_text").schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = worker_encoder(vocabulary.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, of_ids, of_bytes, all_ids = [], [], [], []
                for texts in grouped(part.column(part.num_columns - 1), _GROUP_CHARS):
                    for ids in encoder.encode_all(texts):
                        counts.append(len(ids) // 4)
                        of_ids.append(hashlib.sha256(ids).hexdigest())
                        of_bytes.append(hashlib.sha256(decoder.decode(ids)).hexdigest())
                        if with_ids:
                            all_ids.append(ids)
                out = [*part.columns[:-1], pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                       pa.array(of_bytes, pa.string())]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype("i4")
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(
                        np.frombuffer(b"".join(all_ids), "<u4").astype("i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(run, schema)
