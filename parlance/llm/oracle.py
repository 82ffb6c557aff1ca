"""DuckDB SQL for the operators that SQL can express, written independently of their Spark form."""

from __future__ import annotations

from parlance.llm.quality import CLASSES, QualityRules


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def quality_sql(rules: QualityRules) -> str:
    """op1: windows, lines, histograms, references and distances in long form."""
    word = r"[^\x20\x09-\x0D]+"
    rests, prev = [], "t"
    for i, (_, pattern) in enumerate(CLASSES):
        rests.append(f"r{i} AS (SELECT *, regexp_replace({prev}, {_text(pattern)}, '', 'g') AS x{i} "
                     f"FROM {'w' if i == 0 else f'r{i - 1}'})")
        prev = f"x{i}"
    last = len(CLASSES) - 1
    steps = ["t", *[f"x{i}" for i in range(len(CLASSES))]]
    class_counts = ", ".join([f"length({a}) - length({b})" for a, b in zip(steps, steps[1:], strict=False)]
                             + [f"length(x{last})"])
    blank = [n for n, _ in CLASSES].index("blank") + 1
    forms = ", ".join(_text(f) for b in rules.bins for f in dict.fromkeys((b, b.capitalize(), b.upper())))
    bins = ", ".join(_text(b) for b in rules.bins)
    langs = ", ".join(_text(x) for x in rules.languages)

    def distance(kind: str) -> str:
        m = "((h.p + r.p) / 2)"
        return f"""{kind}_distance AS (
  SELECT doc_id, min(sqrt(greatest(js, 0))) AS d FROM (
    SELECT h.doc_id, r.lang, sum((CASE WHEN h.p > 0 THEN h.p * log2(h.p / {m}) ELSE 0 END
                                + CASE WHEN r.p > 0 THEN r.p * log2(r.p / {m}) ELSE 0 END) / 2) AS js
    FROM {kind}_shares h JOIN {kind}_reference r ON r.k = h.k GROUP BY h.doc_id, r.lang) GROUP BY doc_id)"""

    def shares(kind: str) -> str:
        return f"""{kind}_long AS (
  SELECT doc_id, lang, n_words, unnest({kind}_counts) AS n, unnest(range(len({kind}_counts))) AS k FROM c),
{kind}_shares AS (
  SELECT doc_id, k, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM {kind}_long
  QUALIFY sum(n) OVER (PARTITION BY doc_id) > 0),
{kind}_reference AS (
  SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS p FROM (
    SELECT lang, k, sum(n) AS n FROM {kind}_long
    WHERE lang IN ({langs}) AND n_words >= {rules.min_words} GROUP BY lang, k))"""

    return f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws
           FROM documents),
{', '.join(rests)},
c AS (
  SELECT doc_id, lang, t, ws, len(ws) AS n_words, length(t) AS text_chars, [{class_counts}] AS class_counts,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines,
    list_transform(list_filter(ws, lambda x: list_contains([{forms}], x)), lambda x: lower(x)) AS common,
    list_transform([{bins}], lambda b: len(list_filter(common, lambda x: x = b))) || [len(ws) - len(common)]
      AS word_counts
  FROM r{last}),
windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM c)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS place FROM twice)
            GROUP BY doc_id),
{shares('class')}, {shares('word')}, {distance('class')}, {distance('word')},
j AS (
  SELECT c.*, coalesce(covered.n, 0) AS n_repeat_words, cd.d AS cd, wd.d AS wd,
    n_words < 50 OR 100 * coalesce(covered.n, 0) > 50 * n_words AS base_failed,
    text_chars >= {rules.min_chars} AND coalesce(cd.d, 0) > {rules.max_class_distance} AS far_characters,
    n_words >= {rules.min_words} AND coalesce(wd.d, 0) > {rules.max_word_distance} AS far_words
  FROM c LEFT JOIN covered USING (doc_id) LEFT JOIN class_distance cd USING (doc_id)
    LEFT JOIN word_distance wd USING (doc_id))
SELECT doc_id, n_words, text_chars - class_counts[{blank}] AS word_chars, n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT far_characters AND NOT far_words AS kept,
  round(cd, 6) AS class_distance, round(wd, 6) AS word_distance,
  CASE WHEN base_failed THEN 'base' WHEN far_characters THEN 'characters' WHEN far_words THEN 'words' END AS reason
FROM j"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near_dedup_sql(shingle: int = 5, percent: int = 85) -> str:
    """Exact similarity of all sets that share a shingle, and their components."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT rid, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - {shingle} + 2), lambda i: array_to_string(w[i:i + {shingle - 1}], ' ')) END) AS x
  FROM d),
e AS MATERIALIZED (SELECT rid, len(x) AS n, unnest(x) AS x FROM s),
link AS MATERIALIZED (
  SELECT a.rid AS i, b.rid AS j FROM e a JOIN e b ON a.x = b.x AND a.rid < b.rid
  WHERE 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
ways AS (SELECT i, j FROM link UNION ALL SELECT j, i FROM link),
reach AS (SELECT rid, rid AS r FROM s UNION SELECT reach.rid, ways.j FROM reach JOIN ways ON reach.r = ways.i),
least_id AS (SELECT reach.rid, min(s.doc_id) AS component_id FROM reach JOIN s ON s.rid = reach.r GROUP BY reach.rid)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_shingles, component_id,
       doc_id IS NOT DISTINCT FROM component_id AS kept
FROM s JOIN least_id USING (rid)"""


def clusters_sql(k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> str:
    """All rounds one after the other, on lists of whole numbers."""
    def assign(turn: int) -> str:
        return f"""a{turn} AS MATERIALIZED (
  SELECT rid, vec_id, v, k, d FROM (
    SELECT rid, vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM v, c{turn}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)"""

    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k, v AS c FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) <= {k})""", assign(0)]
    for turn in range(1, rounds + 1):
        steps.append(f"""n{turn} AS (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM (
    SELECT k, p, sum(x) AS s, count(*) AS n FROM (
      SELECT k, unnest(v) AS x, unnest(range(64)) AS p FROM a{turn - 1}) GROUP BY k, p) GROUP BY k)""")
        steps.append(f"""c{turn} AS MATERIALIZED (
  SELECT o.k, CAST(coalesce(n.c, o.c) AS BIGINT[]) AS c FROM c{turn - 1} o LEFT JOIN n{turn} n ON n.k = o.k)""")
        steps.append(assign(turn))
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"""


def phrases_sql(least: int = 10, hidden: int = 50, top: int = 2000) -> str:
    """Phrases of 2 and 3 words; also the least document id of an occurrence."""
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, doc_id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
g AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase, doc_id FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), doc_id FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1),
                                   lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), doc_id FROM w),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f, min(doc_id) AS first_doc FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, first_doc, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= {least}),
cuts AS (
  SELECT *, 1 AS k, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM cand
  UNION ALL SELECT *, 2, array_to_string(w[:2], ' '), w[3] FROM cand WHERE m = 3),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.first_doc, k, l.f AS l, r.f AS r,
         (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
hide AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM cand WHERE m = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE m = 3) GROUP BY ALL),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN hide h ON h.lang = s.lang AND h.phrase = s.phrase
  WHERE h.most IS NULL OR 100 * h.most < {hidden} * s.a)
SELECT r.lang, rank, phrase, a, l, r.r AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score, first_doc
FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= {top}"""
