"""Column-level text functions (all built-in Spark SQL expressions).

These return ``Column`` objects so they compose inside a single projection and
stay within whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for right results:
# Java's String.trim removes every char <= U+0020; Java's "\s" is
# [ \t\n\x0B\f\r]; NGram default n = 2 joined by one space; request defaults
# text "Dummy", type "text", prevTask "na", domainBias "".
JAVA_TRIM_PATTERN = r"\A[\x00-\x20]+|[\x00-\x20]+\z"  # \z: "$" also matches before a final line separator
JAVA_WS = r"[ \t\n\x0B\f\r]"
DEFAULT_TEXT = "Dummy"
DEFAULT_TYPE = "text"
DEFAULT_PREV_TASK = "na"
DEFAULT_BIAS = ""


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_trim(c) -> Column:
    """``String.trim`` semantics: strip chars <= U+0020 at both ends.

    The pattern, which walks the whole text, is only used on texts that have one at an end.
    """
    c = _c(c)
    blank = (F.ascii(F.left(c, F.lit(1))) <= 32) | (F.ascii(F.right(c, F.lit(1))) <= 32)
    return F.when(blank, F.regexp_replace(c, JAVA_TRIM_PATTERN, "")).otherwise(c)


def split_fields(c, sep: str = "\t") -> Column:
    """Java ``String.split(sep)``: trailing empty fields are dropped.

    ``""`` stays ``[""]``; a line made only of separators gives ``[]``.
    """
    c = _c(c)
    esc = sep.replace("\\", "\\\\")
    # the separator itself is not compiled as a pattern, and the strip walks only texts that end in one
    sep_re = "\t" if sep == "\t" else esc
    stripped = F.when(c.endswith(sep), F.regexp_replace(c, f"(?:{sep_re})+\\z", "")).otherwise(c)
    return (F.when(c == "", F.array(F.lit("")))
            .when(stripped == "", F.array().cast("array<string>"))
            .otherwise(F.split(stripped, sep_re)))


def tokenize_sql(text: str) -> str:
    """``tokenize`` as SQL over a string expression."""
    ws = JAVA_WS.replace("\\", "\\\\")
    low = f"lower({text})"
    stripped = f"regexp_replace({low}, '{ws}+\\\\z', '')"
    return (f"CASE WHEN {low} = '' THEN array('') WHEN {stripped} = '' THEN cast(array() AS array<string>) "
            f"WHEN {low} IS NOT NULL THEN split({stripped}, '{ws}') END")


def tokenize(c: str) -> Column:
    """ML ``Tokenizer``: lower-case, split on one Java whitespace char.

    Leading and inner empty tokens stay, trailing ones go; ``""`` -> ``[""]``
    and a whitespace-only text -> ``[]`` (Java split rules).  The one
    definition serves the table operators and the model pipelines.
    """
    return F.expr(tokenize_sql(f"`{c}`"))


def ngrams(words, n: int = 2) -> Column:
    """ML ``NGram``: sliding n-grams joined by a space; fewer than n -> [].

    Built from shifted copies of the array combined by ``zip_with``: no
    lambda body refers to the word array, so even if the optimizer inlines
    the array expression the cost per row stays linear.
    """
    w = _c(words)
    acc = w
    for k in range(2, n + 1):
        acc = F.zip_with(acc, F.slice(w, k, F.greatest(F.size(w) - k + 1, F.lit(0))),
                         lambda a, b: F.concat(a, F.lit(" "), b))
    grams = F.slice(acc, 1, F.size(w) - n + 1) if n > 1 else w
    return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))


def hash_bucket(term, num_buckets: int) -> Column:
    """Bucket of a term: ``pmod(hash(term), N)`` (Spark murmur3, seed 42)."""
    return F.pmod(F.hash(_c(term)), F.lit(num_buckets))


def bucket_ids(terms, num_buckets: int) -> Column:
    return F.transform(_c(terms), lambda t: F.pmod(F.hash(t), F.lit(num_buckets)))


def run_flags(sorted_col) -> Column:
    """Per position of a sorted int array: does a new value start here?"""
    s = _c(sorted_col)
    prev = F.concat(F.array(F.lit(None).cast("int")), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
    return F.zip_with(s, prev, lambda cur, p: p.isNull() | (cur != p))


def run_lengths(sorted_col, flags_col) -> Column:
    """(bucket, tf) structs of a sorted int array and its run-start flags.

    Only element-wise lambdas (``zip_with``/``transform`` over arguments), no
    random access into the arrays: linear per row.
    """
    s, fl = _c(sorted_col), _c(flags_col)
    starts = F.filter(F.transform(fl, lambda f, i: F.when(f, i + 1).otherwise(0)), lambda x: x > 0)
    values = F.filter(F.zip_with(s, fl, lambda v, f: F.when(f, v)), lambda x: x.isNotNull())
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(s) + 1))
    counts = F.zip_with(ends, starts, lambda e, b: (e - b).cast("long"))
    return F.zip_with(values, counts, lambda v, c: F.struct(v.alias("bucket"), c.alias("tf")))


def last_segment(c) -> Column:
    """``s.split("\\.").last``: last dotted segment, trailing dots ignored."""
    return F.element_at(F.split(F.regexp_replace(_c(c), r"\.+\z", ""), r"\."), -1)


def _bias_weights(c) -> Column:
    """Weights ordered by lower-cased pair text; null where a pair has no number."""
    keyed = F.transform(F.split(_c(c), ","), lambda p: F.struct(F.lower(p).alias("k"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda s: F.get(F.split(s["p"], ":"), F.lit(1)).try_cast("double"))


def bias_error(c, n_domains: int = 2) -> Column:
    """Is a non-empty bias malformed (wrong number of pairs, or a weight that is no number)?"""
    c, weights = _c(c), _bias_weights(c)
    bad = (F.size(weights) != n_domains) | F.exists(weights, lambda w: w.isNull())
    return F.coalesce(c.isNotNull() & (c != "") & bad, F.lit(False))


def parse_bias(c, default: float = 0.5, n_domains: int = 2) -> Column:
    """``"nba:0.5,weather:0.5"`` -> weights ordered by lower-cased pair text.

    Empty, missing or malformed (``bias_error``) -> ``[default] * n_domains``,
    so one bad request does not fail its batch.
    """
    c = _c(c)
    dflt = F.array(*[F.lit(float(default)) for _ in range(n_domains)])
    return F.when(c.isNull() | (c == "") | bias_error(c, n_domains), dflt).otherwise(_bias_weights(c))


def sentence_split(c) -> Column:
    """Sentences: split after ., ! or ? followed by whitespace."""
    return F.split(_c(c), r"(?<=[.!?])\s+")


def word_tokens(c) -> Column:
    """Lower-cased letter/digit runs of a text, in order."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"([\p{L}\p{N}]+)"), 1)
