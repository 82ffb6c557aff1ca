"""DuckDB SQL that computes, independently, what each Spark job computes.

Building blocks are SQL text fragments (CTE bodies) shared by the oracle
strings in ``parlance.plans.jobs``.
"""

from __future__ import annotations

# Java whitespace class for RE2 and the Java-trim set (chars <= U+0020).
WS = r"[ \t\n\x0B\f\r]"
JTRIM = r"^[\x00-\x20]+|[\x00-\x20]+$"


def tokens_sql(text: str) -> str:
    """ML Tokenizer in DuckDB (lower, split on one whitespace char)."""
    low = f"lower({text})"
    stripped = f"regexp_replace({low}, '{WS}+$', '')"
    return (f"CASE WHEN {low} = '' THEN [''] WHEN {stripped} = '' THEN []::VARCHAR[] "
            f"ELSE regexp_split_to_array({stripped}, '{WS}') END")


def ngrams_sql(words: str, n: int = 2) -> str:
    parts = " || ' ' || ".join(f"{words}[i + {k}]" for k in range(n))
    return (f"CASE WHEN len({words}) >= {n} THEN list_transform(range(1, len({words}) - {n - 2}), "
            f"lambda i: {parts}) ELSE []::VARCHAR[] END")


def java_trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '{JTRIM}', '', 'g')"


_M = "4294967295"


def _mul(a: str, c: int) -> str:
    return f"((({a})::HUGEINT * {c}) & {_M})"


def _rotl(x: str, r: int) -> str:
    return f"(((({x})::HUGEINT * {2 ** r}) & {_M}) | (({x})::HUGEINT // {2 ** (32 - r)}))"


def murmur3_cte(terms_table: str, term_col: str = "term", num_buckets: int | None = None) -> str:
    """SELECT term, h (Spark ``hash()``), [bucket] FROM terms_table.

    Spark's murmur3 over UTF-8 bytes with seed 42: full 4-byte little-endian
    words, then every tail byte mixed on its own, sign-extended.
    """
    k1 = _mul(_rotl(_mul("k", 3432918353), 15), 461845907)
    h_step = f"((({_rotl('xor(h, k1)', 13)}) * 5 + 3864292196) & {_M})"
    words = ("list_transform(range(0, n // 4), lambda i: ('0x' || substr(hx, 8*i+7, 2) || substr(hx, 8*i+5, 2) "
             "|| substr(hx, 8*i+3, 2) || substr(hx, 8*i+1, 2))::HUGEINT)")
    tail = ("list_transform(range(n // 4 * 4, n), lambda i: ('0x' || substr(hx, 2*i+1, 2))::HUGEINT "
            "+ CASE WHEN ('0x' || substr(hx, 2*i+1, 2))::INTEGER >= 128 THEN 4294967040 ELSE 0 END)")
    fm1 = "xor(h0, n::HUGEINT)"
    fm2 = f"xor({fm1}, {fm1} // 65536)"
    fm3 = _mul(fm2, 2246822507)
    fm4 = f"xor({fm3}, {fm3} // 8192)"
    fm5 = _mul(fm4, 3266489909)
    fm6 = f"xor({fm5}, {fm5} // 65536)"
    bucket = ""
    if num_buckets:
        bucket = f", CAST(((hs % {num_buckets}) + {num_buckets}) % {num_buckets} AS INTEGER) AS bucket"
    return f"""
      SELECT {term_col}, hs AS h{bucket} FROM (
        SELECT {term_col}, CAST(CASE WHEN hu >= 2147483648 THEN hu - 4294967296 ELSE hu END AS BIGINT) AS hs
        FROM (
          SELECT {term_col}, {fm6} AS hu FROM (
            SELECT {term_col}, n,
                   list_reduce([42::HUGEINT] || list_transform({words} || {tail}, lambda k: {k1}),
                               lambda h, k1: {h_step}) AS h0
            FROM (SELECT {term_col}, hex(encode({term_col})) AS hx, octet_length(encode({term_col})) AS n
                  FROM {terms_table}) b
          ) r
        ) f
      ) s"""
