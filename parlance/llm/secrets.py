"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A string of random characters needs many tokens of a byte-level BPE
vocabulary: few characters per token.  Candidates are unbroken runs of
key-like characters that mix letters with digits or both cases; known digests
(hexadecimal of usual digest lengths) and identifiers (UUIDs, plain numbers,
words joined by underscores or hyphens, camel case, paths, versions) are taken
out; the rest is flagged if it has fewer characters per token than the limit.
A run with a UUID in it is judged by what is left without the UUID, and
flagged as a whole.

Spans are in code points, end exclusive.  Cases: a null text counts as empty;
texts without a match have no spans; repeated rows are scanned alike.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import quoted

# The base patterns, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

# What looks random but is not secret.
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
# A part of an identifier; longer runs of one case can be random and are judged by their tokens.
PART = r"(?:[A-Z]?[a-z]{1,19}|[A-Z]{1,19}|[0-9]+)"
# Of versions and dates: a short number (with a time, a unit), a short word with a number, a short digest.
VERSION = (r"v?[0-9]{1,8}(?:[.-](?:[0-9]{1,8}(?:T[0-9]{2,9})?[A-Za-z]{0,2}|(?:[A-Z]?[a-z]{1,10}|[A-Z]{1,10})[0-9]{0,4}))+"
           r"(?:[.-]g?[0-9a-f]{7,8})?")
IDENTIFIER = re.compile(rf"[0-9.,:/+-]+|0[xX][0-9a-fA-F]+|{VERSION}"
                        rf"|{PART}(?:[_./+-]+{PART})*+|[A-Za-z]?[a-z]{{0,18}}(?:[A-Z][a-z]{{1,19}})*+[0-9]{{0,4}}")


@dataclass(frozen=True)
class SecretRules:
    """Parameters of the token-efficiency test."""

    min_length: int = 20
    max_chars_per_token: float = 2.2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base patterns' matches that pass their length rules."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known(run: str) -> bool:
    """A digest or identifier, so no secret by itself."""
    bare = run.strip("=+/_-")
    if len(bare) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", bare):
        return True
    return bool(IDENTIFIER.fullmatch(bare))


@cache
def candidates(min_length: int) -> re.Pattern:
    """Runs of key characters, padding included; the look-behind lets one start at the run's beginning only."""
    return re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{max(min_length - 2, 1)},}}={{0,2}}")


def random_spans(text: str, count_tokens, rules: SecretRules) -> list[tuple[int, int, int]]:
    found = []
    for m in candidates(rules.min_length).finditer(text):
        run = UUID.sub("-", m[0]).strip("-_") if UUID.search(m[0]) else m[0]
        if len(run) >= rules.min_length and not known(run) \
                and len(run) < rules.max_chars_per_token * count_tokens(run):
            found.append((m.start(), 3, m.end()))
    return found


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, or union of overlapping spans, replaced by the mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


_COUNTERS: dict = {}


def _counter(data: bytes, pattern: str):
    """Number of tokens of a string; one encoding per Python worker."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _COUNTERS:
        import tiktoken
        ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in data.splitlines() if x)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _COUNTERS[key] = lambda s: len(encoding.encode_ordinary(s))
    return _COUNTERS[key]


def scanned(docs: DataFrame, vocabulary_path: str, pattern: str, keep: Iterable[str] = (), text: str = "text",
            rules: SecretRules = SecretRules(), redacted: bool = False) -> DataFrame:
    """``keep`` columns plus n_assign, n_access, n_hex, n_random, base_sha256, spans and, if asked, ``_redacted``.

    One pass, no shuffle; the vocabulary, whose size does not depend on the
    data, is broadcast.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    keep = list(keep)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_scanned"))
    added = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    added += ", _redacted string" * redacted
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_tokens = _counter(vocabulary.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts: list[list[int]] = [[], [], [], []]
                digests, rendered, texts = [], [], []
                for value in part.column(part.num_columns - 1):
                    t = value.as_py()
                    base = base_spans(t)
                    spans = sorted(base + random_spans(t, count_tokens, rules))
                    for kind, column in enumerate(counts):
                        column.append(sum(k == kind for _, k, _ in spans))
                    digests.append(hashlib.sha256(render(base).encode()).hexdigest())
                    rendered.append(render(spans))
                    if redacted:
                        texts.append(redact(t, spans))
                arrays = [*part.columns[:-1], *(pa.array(c, pa.int64()) for c in counts),
                          pa.array(digests, pa.string()), pa.array(rendered, pa.string())]
                names = [*keep, "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
                if redacted:
                    arrays.append(pa.array(texts, pa.string()))
                    names.append("_redacted")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, schema)


def redacted_documents(docs: DataFrame, vocabulary_path: str, pattern: str,
                       rules: SecretRules = SecretRules()) -> DataFrame:
    """All documents with their secrets replaced, columns as given; ``n_chars`` follows the text.

    A document without a secret, or with a null text, stays as it is.
    """
    place = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # names of its own, whatever the documents' are
    rows = docs.select(*[F.col(quoted(c)).alias(p) for c, p in place.items()])
    found = scanned(rows, vocabulary_path, pattern, list(place.values()), place["text"], rules, redacted=True)
    hit = F.col("spans") != ""
    value = {c: F.col(p) for c, p in place.items()}
    value["text"] = F.when(hit, F.col("_redacted")).otherwise(value["text"])
    if "n_chars" in value:
        value["n_chars"] = F.when(hit, F.length("_redacted").cast("long")).otherwise(value["n_chars"])
    return found.select(*[v.alias(c) for c, v in value.items()])
