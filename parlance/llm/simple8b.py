"""Token ids in word-aligned binary files: Simple-8b blocks with escapes and per-block offsets.

A 64-bit word holds a 4-bit selector and a 60-bit payload.  The selector says
how many ids of which width the payload packs; selector 0 is an escape: the
next word is one raw id of more than 60 bits.  Ids are cut into blocks of a
fixed number of ids; a block's words begin at its offset, so blocks decode
independently and, without escapes, wholly by array operations.

File: the magic bytes, the blocks' words, then the footer: for each document
its id (with a null flag) and number of token ids, for each block its number
of words and of escapes, and last the four table sizes (documents, blocks,
ids, words), all little-endian 64-bit.  Files are written in ascending order
of document id, one per range partition; a manifest row per finished file
names it, so files of failed attempts are never read.

Cases: a null text counts as empty (only the end id); the string of an added
token in a text is that token, as the library has it; null document ids come
first; rows with equal ids follow each other in order of their texts' hashes;
columns other than id and text are not read, whatever their names; an empty table
gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.bpe import WIDE_BLANKS, chunks
from parlance.llm.common import stored
from parlance.session import scratch_path

MAGIC = b"S8BLOCK1"
#: (ids, bits each) by selector; 0 is the escape, 1 a run of zeros.
PACKS = ((0, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12),
         (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 1024  # ids per block
GROUP = 512  # blocks coded at once
LINES = 500  # chunks given to the library as one text
WIDTHS = (1, 2, 4)  # 64-bit numbers of a word, by table
MANY = 1 << 15  # words looked up at once
PART = 1 << 20  # bytes of texts encoded at once, and what is left of the last text

# Kinds of bytes (a lead byte of white space beyond ASCII is looked at closer), and that white space.
_WHITE, _BLANK, _LETTER, _MARK, _OTHER, _ODD, _ASK = 0, 1, 2, 3, 4, 5, 6
_KIND = np.full(256, _OTHER, "u1")
for _bytes, _kind in ((b"\t\n\v\f\r", _WHITE), (b" ", _BLANK), (string.ascii_letters.encode(), _LETTER),
                      (string.punctuation.encode(), _MARK), (b"\0\x1c\x1d\x1e\x1f", _ODD), (b"\xc2\xe1\xe2\xe3", _ASK)):
    _KIND[list(_bytes)] = _kind
_WIDE = np.array([int.from_bytes(c.encode().ljust(3, b"\0"), "big") for c in WIDE_BLANKS], "u4")
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], "u8")  # the first n bytes
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the ids, and by block the number of words and of escapes.

    The widest pack that fits is chosen at each position for all positions at
    once; the starts are then found by stepping through all blocks together.
    """
    ids = np.asarray(ids)
    ids = ids if ids.dtype == np.dtype("u4") else ids.astype("u8")
    n = len(ids)
    if not n:
        return np.empty(0, "u8"), np.empty(0, "i8"), np.empty(0, "i8")
    every = np.arange(n)
    left = np.minimum(block - every % block, n - every)  # ids that remain in the block
    pick = np.full(n, len(PACKS) - 1, "i8")
    widest = int(ids.max()).bit_length()
    first = len(PACKS) - 1  # the packs from here on hold any of these ids, wherever enough remain
    while first > 2 and PACKS[first - 1][1] >= widest:
        first -= 1
        pick[left >= PACKS[first][0]] = first
    if widest > PACKS[-1][1]:
        pick[ids > (1 << PACKS[-1][1]) - 1] = 0
    seen = PACKS[first][0]
    largest = ids[:max(n - seen + 1, 0)]  # largest of the next ``seen`` ids at each place still in question
    for k in range(1, seen):
        largest = np.maximum(largest, ids[k:n - seen + 1 + k])
    at = every[:len(largest)]
    for selector in range(first - 1, 0, -1):  # a pack of more ids fits only where one of fewer does
        count, bits = PACKS[selector]
        on = left[at] >= count
        if not on.all():
            at, largest = at[on], largest[on]
        for k in range(seen, count):
            largest = np.maximum(largest, ids[at + k])
        seen = count
        on = largest <= min((1 << bits) - 1, np.iinfo(ids.dtype).max)
        if not on.all():
            at, largest = at[on], largest[on]
        if not len(at):
            break
        pick[at] = selector
    counts = np.array([1] + [c for c, _ in PACKS[1:]])
    starts = np.zeros(n, bool)
    lane = np.arange(0, n, block)
    end = np.minimum(lane + block, n)
    while len(lane):
        starts[lane] = True
        lane = lane + counts[pick[lane]]
        on = lane < end
        lane, end = lane[on], end[on]
    at = np.flatnonzero(starts)
    chosen = pick[at]
    place = np.concatenate([[0], np.cumsum(1 + (chosen == 0))])
    words = np.zeros(place[-1], "u8")
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        count, bits = PACKS[selector]
        if selector == 0:
            words[place[mine] + 1] = ids[at[mine]]
            continue
        payload = np.zeros(len(mine), "u8")
        for k in range(count if bits else 0):
            payload |= ids[at[mine] + k].astype("u8") << np.uint64(k * bits)
        words[place[mine]] = payload << np.uint64(4) | np.uint64(selector)
    of_block = at // block
    n_blocks = -(-n // block)
    return (words, np.bincount(of_block, 1 + (chosen == 0), n_blocks).astype("i8"),
            np.bincount(of_block, chosen == 0, n_blocks).astype("i8"))


def decode_words(words: np.ndarray) -> np.ndarray:
    """Ids of words without escapes."""
    selector = (words & np.uint64(15)).astype("i8")
    counts = np.array([c for c, _ in PACKS])[selector]
    place = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(place[-1], "u8")
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        count, bits = PACKS[s]
        payload, mask = words[mine] >> np.uint64(4), np.uint64((1 << bits) - 1)
        for k in range(count if bits else 0):
            out[place[mine] + k] = payload >> np.uint64(k * bits) & mask
    return out


def decode_blocks(words: np.ndarray, n_words: np.ndarray, n_escapes: np.ndarray) -> np.ndarray:
    """Ids of whole blocks; runs of blocks without escapes are decoded at once."""
    ends = np.cumsum(n_words)
    out, begun = [], 0
    for b in np.flatnonzero(n_escapes):
        first = ends[b] - n_words[b]
        out.append(decode_words(words[begun:first]))
        i = first
        while i < ends[b]:  # an escape's raw word can look like any other: word by word
            if words[i] & np.uint64(15):
                out.append(decode_words(words[i:i + 1]))
                i += 1
            else:
                out.append(words[i + 1:i + 2])
                i += 2
        begun = ends[b]
    out.append(decode_words(words[begun:]))
    return np.concatenate(out)


def _open_fs(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(folder)
    return pyarrow.fs.LocalFileSystem(), folder


def write_file(path: str, documents: Iterator[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Writes documents (id, token ids as little-endian unsigned 32-bit); returns their and their ids' number.

    Holds GROUP blocks of ids at a time, besides two numbers per document.
    """
    fs, at = _open_fs(path)
    doc_ids, is_null, lengths = array("q"), array("q"), array("q")
    words_of, escapes_of = array("q"), array("q")
    waiting, size, n_ids = [], 0, 0
    full = 4 * BLOCK * GROUP

    def flush(out, whole: bool) -> None:
        nonlocal waiting, size, n_ids
        data = b"".join(waiting)
        cut = len(data) if whole else len(data) // full * full
        for i in range(0, cut, full):
            ids = np.frombuffer(data[i:min(i + full, cut)], "<u4")
            words, n_words, n_escapes = encode_blocks(ids)
            out.write(words.astype("<u8").tobytes())
            words_of.extend(n_words.tolist())
            escapes_of.extend(n_escapes.tolist())
            n_ids += len(ids)
        waiting, size = [data[cut:]], len(data) - cut

    with fs.open_output_stream(at) as out:
        out.write(MAGIC)
        for doc_id, ids in documents:
            doc_ids.append(doc_id or 0)
            is_null.append(doc_id is None)
            lengths.append(len(ids) // 4)
            waiting.append(ids)
            size += len(ids)
            if size >= full:
                flush(out, False)
        flush(out, True)
        for part in (is_null, doc_ids, lengths, words_of, escapes_of):
            out.write(np.array(part, "<i8").tobytes())
        out.write(np.array([len(doc_ids), len(words_of), n_ids, sum(words_of)], "<i8").tobytes())
    return len(doc_ids), n_ids


def read_file(path: str) -> Iterator[tuple[int | None, int, int]]:
    """(document id, number of ids, crc32 of the ids) of a file, decoding GROUP blocks at a time."""
    fs, at = _open_fs(path)
    with fs.open_input_file(at) as f:
        end = f.size()
        f.seek(end - 32)
        n_docs, n_blocks, n_ids, n_words = np.frombuffer(f.read(32), "<i8").tolist()
        f.seek(end - 32 - 8 * (3 * n_docs + 2 * n_blocks))
        table = lambda n: np.frombuffer(f.read(8 * n), "<i8")
        is_null, doc_ids, lengths, words_of, escapes_of = (table(n) for n in (n_docs,) * 3 + (n_blocks,) * 2)
        f.seek(0)
        if f.read(len(MAGIC)) != MAGIC or len(MAGIC) + 8 * n_words + 8 * (3 * n_docs + 2 * n_blocks) + 32 != end:
            raise ValueError(f"not a token file: {path}")

        def groups() -> Iterator[bytes]:
            for b in range(0, n_blocks, GROUP):
                n = words_of[b:b + GROUP]
                words = np.frombuffer(f.read(8 * int(n.sum())), "<u8")
                yield decode_blocks(words, n, escapes_of[b:b + GROUP]).astype("<u4").tobytes()

        more, have, used = groups(), b"", 0
        for doc_id, null, length in zip(doc_ids.tolist(), is_null.tolist(), lengths.tolist(), strict=True):
            crc, want = 0, 4 * length
            while want:
                if used == len(have):
                    have, used = next(more), 0
                part = have[used:used + want]
                crc, used, want = zlib.crc32(part, crc), used + len(part), want - len(part)
            yield None if null else doc_id, length, crc


class WordTable:
    """A number above 0 by word of at most 8 * ``width`` bytes, for many words at once.

    A word is ``width`` 64-bit numbers, its bytes with zeros after them (no
    word has a zero byte), and is compared whole.  Open addressing; at least
    half of the places are free.
    """

    def __init__(self, width: int):
        self.width, self.n = width, 0
        self.rows = np.zeros((1 << 12, width + 1), "u8")  # the word, its number (0: free)

    def places(self, words: np.ndarray) -> np.ndarray:
        mixed = words[:, 0] * _SPREAD
        for k in range(1, self.width):
            mixed = (mixed ^ mixed >> np.uint64(29) ^ words[:, k]) * _SPREAD
        return (mixed >> np.uint64(65 - len(self.rows).bit_length())).astype("i8")

    def find(self, words: np.ndarray) -> np.ndarray:
        """The words' numbers, 0 for those that are missing."""
        out, todo, at = np.zeros(len(words), "u8"), np.arange(len(words)), self.places(words)
        while len(todo):
            rows = self.rows.take(at, 0)
            number = rows[:, -1]
            same = rows[:, 0] == words[:, 0]
            for k in range(1, self.width):
                same &= rows[:, k] == words[:, k]
            out[todo[same]] = number[same]
            on = np.flatnonzero(~same & (number != 0))
            todo, words, at = todo[on], words[on], at[on] + 1 & len(self.rows) - 1
        return out

    def add(self, words: np.ndarray, numbers: np.ndarray) -> None:
        """Adds different words, none of them in the table, with different numbers."""
        size = len(self.rows)
        while 2 * (self.n + len(words)) > size:
            size *= 2
        if size > len(self.rows):
            old = self.rows[self.rows[:, -1] != 0]
            self.n, self.rows = 0, np.zeros((size, self.width + 1), "u8")
            self.add(old[:, :-1], old[:, -1])
        self.n += len(words)
        at = self.places(words)
        while len(at):
            free = self.rows[at, -1] == 0
            self.rows[at[free], -1] = numbers[free]  # one of the words that want a place has it then
            mine = self.rows[at, -1] == numbers
            self.rows[at[mine], :-1] = words[mine]
            words, numbers, at = words[~mine], numbers[~mine], at[~mine] + 1 & size - 1


def cut_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks of texts begin that are tokenized independently of each other, and which texts cannot be cut so.

    ``data`` has the texts' bytes (UTF-8), one after the other, between
    ``offsets``, and at least 2 more.  A chunk begins with every text; where
    white space begins; at the last character of white space before another
    character, and behind it if it is no blank; and at an ASCII mark behind a
    letter.  Texts with white space beyond ASCII, or with control characters
    that may count as such, cannot be cut so.
    """
    end = int(offsets[-1])
    kind = _KIND[data[:end]]
    at = np.flatnonzero(kind >= _ODD)
    code = data[at].astype("u4") << 16 | data[at + 1].astype("u4") << 8 | data[at + 2]
    at = at[(kind[at] == _ODD) | np.isin(code, _WIDE) | np.isin(code & 0xFFFF00, _WIDE[_WIDE & 255 == 0])]
    odd = np.zeros(len(offsets) - 1, bool)
    odd[np.searchsorted(offsets, at, "right") - 1] = True
    first = np.zeros(end + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]  # without an empty text at the end
    white = kind <= _BLANK
    last = white[:-1] & ~white[1:] & ~first[1:]  # of white space before another character of the text
    begins = first
    begins[1:] |= white[1:] & ~white[:-1]
    begins[1:] |= last & (kind[:-1] == _WHITE)
    begins[:-1] |= last
    at = np.flatnonzero(kind == _MARK)
    at = at[at > 1]
    one, two = data[at - 1], data[at - 2]
    letter = (kind[at - 1] == _LETTER) | (two == 0xC3) & (one != 0x97) & (one != 0xB7)
    begins[at[letter]] = True
    return np.flatnonzero(begins), odd


class LibraryIds(dict):
    """Ids by chunk from the tokenizers library (little-endian unsigned 32-bit).

    Chunks of up to 32 bytes of texts that are cut as arrays are in tables,
    which are emptied together when they have ``words`` of them; all others
    are keys, in two bounded generations.
    """

    def __init__(self, tokenizer_json: str, pattern: str, limit: int = 500_000, longest: int = 64,
                 words: int = 1_000_000):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        loaded = json.loads(tokenizer_json)
        self.added = [t["content"] for t in loaded["added_tokens"]]
        # the same vocabulary and pre-tokens without added tokens; what it is given does not come twice
        self.lines = Tokenizer.from_str(json.dumps({**loaded, "added_tokens": []}))
        (self.feed,) = self.lines.encode("\n", add_special_tokens=False).ids
        self.pattern, self.limit, self.longest, self.old = regex.compile(pattern), limit, longest, {}
        self.words = words
        self.forget()

    def forget(self) -> None:
        self.tables = [WordTable(w) for w in WIDTHS]
        self.ids, self.used = np.zeros(1 << 12, "u4"), 0  # ids of the tables' words

    def learn(self, new: list[str]) -> list[bytes]:
        """Ids of new chunks.

        They go to the library many at a time, as lines of one text: a line
        feed before another character is a pre-token of its own, so the ids are
        cut at the line feeds.  Chunks with other white space go alone.
        """
        out, lines = [b""] * len(new), []
        for i, c in enumerate(new):
            if "\n" in c or c[-1:].isspace():
                out[i] = array("I", self.lines.encode(c, add_special_tokens=False).ids).tobytes()
            else:
                lines.append(i)
        for at in range(0, len(lines), LINES):
            part = lines[at:at + LINES]
            text = "\n".join([new[i] for i in part])
            ids = np.array(self.lines.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            data, begun = ids.tobytes(), 0
            for i, e in zip(part, [*np.flatnonzero(ids == self.feed).tolist(), len(ids)], strict=True):
                out[i] = data[4 * begun:4 * e]
                begun = e + 1
        return out

    def of_chunks(self, cut: list[str]) -> list[bytes]:
        """Ids of chunks; each is looked up once, and those that are missing, and only they, are learned together."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        out = list(map(self.get, cut))
        lost = [k for k, x in enumerate(out) if x is None]
        missing = dict.fromkeys([cut[k] for k in lost])
        unknown = [c for c in missing if c not in self.old]
        missing = {c: self.old.get(c) for c in missing} | dict(zip(unknown, self.learn(unknown), strict=True))
        for k in lost:
            out[k] = missing[cut[k]]
        self.update((c, x) for c, x in missing.items() if len(c) <= self.longest)
        return out

    def of_words(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of ``sizes`` bytes at ``begins``, one after the other, and each word's number of ids.

        ``data`` has at least 48 bytes more than the words, and whole 64-bit numbers.
        """
        longs, text = data.view("<u8"), data.tobytes()
        strings = lambda at: [text[b:e] for b, e in zip(
            begins[at].tolist(), (begins[at] + sizes[at]).tolist(), strict=True)]
        number = np.zeros(len(begins), "u8")  # where a word's ids begin, and in the low half how many there are
        missing, of_word, which = [], {}, []  # different missing words are counted in the order they are met
        for table, below in zip(self.tables, (0, *(8 * w for w in WIDTHS)), strict=False):
            every = np.flatnonzero((sizes > below) & (sizes <= 8 * table.width))
            for k in range(0, len(every), MANY):
                mine = every[k:k + MANY]
                at, size = begins[mine], sizes[mine]
                place, shift = at >> 3, (at & 7).astype("u8") << np.uint64(3)
                words, low = np.empty((len(mine), table.width), "u8"), longs[place]
                for w in range(table.width):
                    high = longs[place + (w + 1)]
                    words[:, w] = low >> shift | high << np.uint64(1) << (np.uint64(63) - shift)
                    if 8 * w + 8 > below:
                        words[:, w] &= _KEEP[np.clip(size - 8 * w, 0, 8)]
                    low = high
                number[mine] = found = table.find(words)
                lost = np.flatnonzero(found == 0)
                known = len(of_word)
                own = np.array([of_word.setdefault(c, len(of_word)) for c in strings(mine[lost])], "i8")
                new, first = np.unique(own, return_index=True)
                on = np.searchsorted(new, known)  # those before were met in another block
                missing.append((table, words[lost[first[on:]]], new[on:]))
                which.append((mine[lost], own))
        kept = self.learn([c.decode() for c in of_word])
        alone = np.flatnonzero(sizes > 8 * WIDTHS[-1])
        own = kept + self.of_chunks([c.decode() for c in strings(alone)])
        ids, count = np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), "u8", len(own)) >> np.uint64(2)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(self.used + 2 * len(ids), "u4")])
        self.ids[self.used:self.used + len(ids)] = ids
        numbers = np.cumsum(count) - count + np.uint64(self.used) << np.uint64(32) | count
        self.used += int(count[:len(kept)].sum())  # ids of the long ones are written over
        number[alone] = numbers[len(kept):]
        for at, own in which:
            number[at] = numbers[own]
        for table, words, own in missing:
            table.add(words, numbers[own])
        count = (number & np.uint64(0xFFFFFFFF)).astype("i8")
        place = (number >> np.uint64(32)).astype("i8")
        out, done = np.empty(count.sum(), "u4"), 0
        for k in range(0, len(count), MANY):
            n = count[k:k + MANY]
            stops = np.cumsum(n)
            at = np.repeat(place[k:k + MANY] - (stops - n), n)
            at += np.arange(len(at))
            out[done:done + len(at)] = self.ids[at]
            done += len(at)
        return out, count

    def encode(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """Ids of each whole text and the end id.

        A text with the string of an added token goes to the library whole,
        which makes that token of it; all others are put together from chunks.
        """
        if sum(t.n for t in self.tables) >= self.words:
            self.forget()
        texts = texts.cast(pa.large_string())
        _, offsets, held = texts.buffers()
        offsets = np.frombuffer(offsets, "<i8")[texts.offset:texts.offset + len(texts) + 1]
        size = int(offsets[-1] - offsets[0])
        data = np.zeros((size + 55) // 8 * 8, "u1")
        if size:
            data[:size] = np.frombuffer(held, "u1")[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        begins, odd = cut_places(data, offsets)
        sizes, text = np.diff(begins, append=size), data.tobytes()
        for a in self.added:
            if a.encode() in text:
                odd |= pa.compute.match_substring(texts, a).to_numpy(zero_copy_only=False)
        if odd.any():
            on = ~odd[np.searchsorted(offsets, begins, "right") - 1]
            begins, sizes = begins[on], sizes[on]
        ids, count = self.of_words(data, begins, sizes)
        stops = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(begins, offsets)] * 4
        ids, stops = ids.astype("<u4").tobytes(), stops.tolist()
        out = [ids[a:b] + end for a, b in itertools.pairwise(stops)]
        for i in np.flatnonzero(odd).tolist():
            t = texts[i].as_py()
            if any(a in t for a in self.added):
                own = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                own = b"".join(self.of_chunks(chunks(t, self.pattern)))
            out[i] = own + end
        return out


_LIBRARY: dict = {}


def _library(data: str, pattern: str) -> LibraryIds:
    key = (hashlib.sha256(data.encode()).digest(), pattern)
    if key not in _LIBRARY:
        _LIBRARY[key] = LibraryIds(data, pattern)
    return _LIBRARY[key]


def write_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, folder: str | None = None,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the token files of all documents in ascending order of ``doc_id``; returns the manifest.

    ``pattern`` is the tokenizer's own pre-token pattern.  One range shuffle
    of the texts, by id, hash of the text and place in the input, so rows of
    one id are cut into ranges like any others; every task writes one file,
    under a name of its own.
    Manifest: file (in order, from 0), path, n_docs, n_ids, start (ids of all
    files before).
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "parlance-llm", "tokens")
    fs, at = _open_fs(folder)
    fs.create_dir(at, recursive=True)
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        library = _library(vocabulary.value, pattern)
        first: list = []

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                if not first:
                    first.extend(c[0].as_py() for c in (batch.column(0), *batch.columns[2:]))
                begun, size = 0, 0
                texts = batch.column(1)
                weights = pa.compute.binary_length(texts).to_pylist()
                for i, w in enumerate(weights):
                    size += w
                    if size >= PART or i + 1 == len(ids):
                        part = library.encode(texts.slice(begun, i + 1 - begun), end)
                        yield from zip(ids[begun:i + 1], part, strict=True)
                        begun, size = i + 1, 0

        documents = rows()
        one = next(documents, None)
        if one is None:
            return
        path = f"{folder}/{uuid.uuid4().hex}.s8b"

        def all_rows():
            yield one
            yield from documents

        n_docs, n_ids = write_file(path, all_rows())
        yield pa.RecordBatch.from_pydict({**{f"first_{k}": pa.array([v], pa.int64()) for k, v in
                                             zip(("id", "hash", "place"), first, strict=True)}, "path": [path],
                                          "n_docs": pa.array([n_docs], pa.int64()),
                                          "n_ids": pa.array([n_ids], pa.int64())})

    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), t.alias("_text"), F.xxhash64(t).alias("_hash"),
                       F.monotonically_increasing_id().alias("_place"))
    ordered = rows.repartitionByRange("_id", "_hash", "_place").sortWithinPartitions("_id", "_hash", "_place")
    files = stored(ordered.mapInArrow(
        run, "first_id long, first_hash long, first_place long, path string, n_docs long, n_ids long"), "manifest")
    by_order = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash", "first_place")  # one row per file
    before = by_order.rowsBetween(Window.unboundedPreceding, -1)
    return files.select((F.row_number().over(by_order) - 1).alias("file"), "path", "n_docs", "n_ids",
                        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))


def read_tokens(manifest: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document of the files: its id, start (ids of all documents before), n_tokens, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, out = row["start"], []
                for d, n, crc in read_file(row["path"]):
                    out.append((d, at, n, crc))
                    at += n
                if at - row["start"] != row["n_ids"]:
                    raise ValueError(f"{row['path']}: {at - row['start']} ids, {row['n_ids']} written")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [doc_id, "start", "n_tokens", "ids_crc32"])

    n = manifest.count()
    return manifest.select("path", "start", "n_ids").repartition(max(n, 1)).mapInArrow(
        run, f"`{doc_id}` long, start long, n_tokens long, ids_crc32 long")
