"""The registered jobs: one callable (spark, sf_dir) -> DataFrame per operator
of SURVEY §2, each paired (where SQL can say it) with DuckDB SQL that
computes the same result independently.

All jobs read the full driver tables; nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import features as FE
from parlance.operators import labels as LB
from parlance.operators import slots as SL
from parlance.plans import oracle_sql as O
from parlance.plans import sources as S
from parlance.sources import lines as L
from parlance.sources import tables as TB

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def job(name: str, sql: str | None = None):
    def deco(fn):
        JOBS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- text layer
_TOK = O.tokens_sql("text")

@job("q_tokenize", f"""
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, array_to_string(w, '|') AS words
FROM (SELECT doc_id, {_TOK} AS w FROM documents)""")
def q_tokenize(spark, sf):
    d = FE.tokenize(S.documents(spark, sf, ("doc_id", "text")), "text")
    return d.select("doc_id", F.size("words").alias("n_words"), F.array_join("words", "|").alias("words"))


@job("q_ngrams", f"""
SELECT doc_id, CAST(len(g) AS INTEGER) AS n_ngrams, array_to_string(g, '|') AS ngrams
FROM (SELECT doc_id, {O.ngrams_sql('w')} AS g FROM (SELECT doc_id, {_TOK} AS w FROM documents))""")
def q_ngrams(spark, sf):
    d = FE.ngrams(FE.tokenize(S.documents(spark, sf, ("doc_id", "text")), "text"))
    return d.select("doc_id", F.size("ngrams").alias("n_ngrams"), F.array_join("ngrams", "|").alias("ngrams"))


_GRAMS = f"""toks AS (SELECT doc_id, {_TOK} AS w FROM documents),
 grams AS (SELECT doc_id, unnest({O.ngrams_sql('w')}) AS term FROM toks)"""

@job("q_hash_buckets", f"""
WITH {_GRAMS}, terms AS (SELECT DISTINCT term FROM grams)
SELECT term, CAST(h AS INTEGER) AS h, bucket FROM ({O.murmur3_cte('terms', 'term', FE.DOMAIN_FEATURES)})""")
def q_hash_buckets(spark, sf):
    d = FE.ngrams(FE.tokenize(S.documents(spark, sf, ("doc_id", "text")), "text"))
    terms = d.select(F.explode_outer("ngrams").alias("term")).filter(F.col("term").isNotNull()).distinct()
    return terms.select("term", F.hash("term").alias("h"), T.hash_bucket("term", FE.DOMAIN_FEATURES).alias("bucket"))


@job("q_hashed_tf", f"""
WITH {_GRAMS}, terms AS (SELECT DISTINCT term FROM grams),
 hb AS ({O.murmur3_cte('terms', 'term', FE.DOMAIN_FEATURES)})
SELECT g.doc_id, hb.bucket, count(*) AS tf FROM grams g JOIN hb USING (term) GROUP BY g.doc_id, hb.bucket""")
def q_hashed_tf(spark, sf):
    return FE.hashed_tf(S.documents(spark, sf, ("doc_id", "text")), "doc_id", "text", FE.DOMAIN_FEATURES)


@job("q_contains_counts", r"""
WITH lines AS (
  SELECT unnest(CASE WHEN text = '' THEN [''] WHEN regexp_replace(text, '\n+$', '') = '' THEN []::VARCHAR[]
                ELSE string_split(regexp_replace(text, '\n+$', ''), chr(10)) END) AS line FROM documents)
SELECT * FROM (VALUES ('a'), ('b')) nd(needle),
  LATERAL (SELECT count(*) AS n_lines FROM lines WHERE contains(line, nd.needle))""")
def q_contains_counts(spark, sf):
    docs = S.documents(spark, sf, ("doc_id", "text"))
    lines = docs.select(F.explode_outer(T.split_fields(F.col("text"), "\n")).alias("line")).filter(
        F.col("line").isNotNull())
    return FE.contains_counts(lines, "line", ["a", "b"])


# ---------------------------------------------------------------- sources
def _split_sql(x: str, sep_char: str) -> str:
    """Java split on a one-char separator, trailing empty fields dropped."""
    sep_re = {"\t": r"\t", ",": ","}[sep_char]
    sep_lit = {"\t": "chr(9)", ",": "','"}[sep_char]
    stripped = f"regexp_replace({x}, '({sep_re})+$', '')"
    return (f"(CASE WHEN {x} = '' THEN [''] WHEN {stripped} = '' THEN []::VARCHAR[] "
            f"ELSE string_split({stripped}, {sep_lit}) END)")


_ONE_LINE = r"regexp_replace({x}, '[\t\r\n]', ' ', 'g')"
_DOC_LINES = f"SELECT doc_id AS line_id, concat_ws(chr(9), {_ONE_LINE.format(x='text')}, lang) AS value FROM documents"

@job("q_parse_utterances", f"""
SELECT line_id, p[1] AS utterance, {O.java_trim_sql('p[2]')} AS strLabel
FROM (SELECT line_id, {_split_sql('value', chr(9))} AS p FROM ({_DOC_LINES}))""")
def q_parse_utterances(spark, sf):
    lines = TB.utterance_lines(S.documents(spark, sf))
    return L.parse_utterances(lines, min_fields=1, trim_text=False, keep=("line_id",))


_INTENT_LINES = f"""
SELECT d.doc_id AS line_id, CASE WHEN d.lang = 'en' THEN 'nba' ELSE 'weather' END AS domain,
  concat_ws(chr(9), {_ONE_LINE.format(x='d.text')},
    CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'quality'
         WHEN l.quality IS NOT NULL THEN 'Other' END) AS value
FROM documents d LEFT JOIN labels l USING (doc_id)"""

_INTENT_ROWS = f"""
SELECT line_id, domain, {O.java_trim_sql('p[1]')} AS utterance, {O.java_trim_sql('p[2]')} AS strLabel
FROM (SELECT line_id, domain, {_split_sql('value', chr(9))} AS p FROM ({_INTENT_LINES})) WHERE len(p) >= 2"""

@job("q_parse_filtered", f"SELECT line_id, utterance, strLabel FROM ({_INTENT_ROWS})")
def q_parse_filtered(spark, sf):
    return L.parse_utterances(S.intent_lines(spark, sf), min_fields=2, keep=("line_id",))


def _intent_rows(spark, sf):
    return L.parse_utterances(S.intent_lines(spark, sf), min_fields=2, keep=("line_id", "domain"))


_TURN_LINES = f"""
SELECT conv_id, turn, concat_ws(chr(9), {_ONE_LINE.format(x='text')},
  coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'na'), role,
  CASE conv_id % 3 WHEN 0 THEN 'nba' WHEN 1 THEN 'weather' END) AS value
FROM conversations"""

_TURNS = f"""
SELECT conv_id, turn, p[1] AS utterance, p[2] AS previousTask, p[3] AS strLabel, p[4] AS domain
FROM (SELECT conv_id, turn, {_split_sql('value', chr(9))} AS p FROM ({_TURN_LINES})) WHERE len(p) >= 3"""

@job("q_parse_turns", _TURNS)
def q_parse_turns(spark, sf):
    return S.turns(spark, sf)


_PRODUCT_DICT = f"""
SELECT slot, slot_order, alias, min(canonical) AS canonical FROM (
  SELECT 'product' AS slot, 1 AS slot_order, lower(p[1]) AS canonical, lower(unnest(p[2:])) AS alias
  FROM (SELECT {_split_sql("concat_ws(',', p_brand, p_name, p_type)", ',')} AS p FROM part) WHERE len(p) > 1)
GROUP BY slot, slot_order, alias"""

@job("q_slot_dictionary", _PRODUCT_DICT)
def q_slot_dictionary(spark, sf):
    return L.parse_dictionary(S.product_dictionary_lines(spark, sf))


# ---------------------------------------------------------------- slots
_W = r"[^\pL\pN_]"

def _slot_pass_sql(x: str, alt: str, slot: str) -> tuple[str, str]:
    """(count expr, replaced expr) for one slot: two passes cover matches
    whose left neighbour separator was consumed by the previous match."""
    pat = f"({_W}|^)({alt})({_W}|$)"
    c1 = f"len(regexp_extract_all({x}, '{pat}'))"
    r1 = f"regexp_replace({x}, '{pat}', '\\1{slot}\\3', 'g')"
    c2 = f"len(regexp_extract_all({r1}, '{pat}'))"
    r2 = f"regexp_replace({r1}, '{pat}', '\\1{slot}\\3', 'g')"
    return f"({c1} + {c2})", r2


# Oracle alternations written out (longest first), matching the inline fixture.
_SLOT_ALTS = [("quantifier", "that|this"), ("preposition", "of the|from|with|of")]

def _slots_sql() -> str:
    x0 = "lower(text)"
    c1, r1 = _slot_pass_sql("t0", _SLOT_ALTS[0][1], _SLOT_ALTS[0][0])
    c2, r2 = _slot_pass_sql("t1", _SLOT_ALTS[1][1], _SLOT_ALTS[1][0])
    return f"""
SELECT doc_id, t2 AS utterance_slots, CAST(n1 + n2 AS INTEGER) AS n_slots, CAST(n1 AS INTEGER) AS n1,
       CAST(n2 AS INTEGER) AS n2, t0, t1 FROM (
  SELECT *, {c2} AS n2, {r2} AS t2 FROM (
    SELECT *, {c1} AS n1, {r1} AS t1 FROM (SELECT doc_id, {x0} AS t0 FROM documents)))"""


@job("q_replace_slots", f"SELECT doc_id, utterance_slots, n_slots FROM ({_slots_sql()})")
def q_replace_slots(spark, sf):
    pats = SL.slot_patterns(S.slot_dictionary(spark))
    d = SL.replace_slots(S.documents(spark, sf, ("doc_id", "text")), "text", pats)
    return d.select("doc_id", "utterance_slots", "n_slots")


@job("q_replace_slots_join", f"SELECT doc_id, utterance_slots, n_slots FROM ({_slots_sql()})")
def q_replace_slots_join(spark, sf):
    """The form for dictionary tables (tokens joined to the aliases) on the same input."""
    d = SL.replace_slots_join(S.documents(spark, sf, ("doc_id", "text")), "text", S.slot_dictionary(spark))
    return d.select("doc_id", "utterance_slots", "n_slots")


@job("q_slot_counts", f"""
SELECT doc_id, 'quantifier' AS slot, n1 AS n FROM ({_slots_sql()})
UNION ALL SELECT doc_id, 'preposition' AS slot, n2 AS n FROM ({_slots_sql()})""")
def q_slot_counts(spark, sf):
    pats = SL.slot_patterns(S.slot_dictionary(spark))
    return SL.slot_counts(S.documents(spark, sf, ("doc_id", "text")), "doc_id", "text", pats)


def _entities_sql() -> str:
    """Per (doc, slot, alias): how often the alias was replaced (both passes)."""
    parts = []
    for i, (slot, alt) in enumerate(_SLOT_ALTS):
        pat = f"({_W}|^)({alt})({_W}|$)"
        r1 = f"regexp_replace(t{i}, '{pat}', '\\1{slot}\\3', 'g')"
        parts.append(f"""
  SELECT doc_id, '{slot}' AS slot, unnest(regexp_extract_all(t{i}, '{pat}', 2)
                                          || regexp_extract_all({r1}, '{pat}', 2)) AS alias
  FROM ({_slots_sql()})""")
    return " UNION ALL ".join(parts)


_SLOT_DICT_SQL = """
SELECT slot, alias, min(canonical) AS canonical FROM (
  SELECT slot, lower(p[1]) AS canonical, lower(unnest(p[2:])) AS alias
  FROM (SELECT * FROM (VALUES ('quantifier', 'that,that'), ('quantifier', 'this,this'), ('preposition', 'with,with'),
                              ('preposition', 'from,from'), ('preposition', 'of,of the,of')) v(slot, line)),
       LATERAL (SELECT string_split(line, ',') AS p))
GROUP BY slot, alias"""


@job("q_slot_entities", f"""
SELECT e.doc_id, e.slot, e.alias, d.canonical, count(*) AS n
FROM ({_entities_sql()}) e LEFT JOIN ({_SLOT_DICT_SQL}) d ON d.slot = e.slot AND d.alias = e.alias
GROUP BY e.doc_id, e.slot, e.alias, d.canonical""")
def q_slot_entities(spark, sf):
    pats = SL.slot_patterns(S.slot_dictionary(spark))
    ents = SL.find_entities(S.documents(spark, sf, ("doc_id", "text")), "doc_id", "text",
                            S.slot_dictionary(spark), pats)
    return ents.groupBy("doc_id", "slot", "alias", "canonical").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- labels
@job("q_label_keys", f"SELECT DISTINCT strLabel AS key FROM ({_INTENT_ROWS}) WHERE strLabel <> 'Other'")
def q_label_keys(spark, sf):
    rows = L.parse_utterances(S.intent_label_lines(spark, sf), min_fields=2, keep=("line_id", "domain"))
    return LB.label_keys(rows)


_LABEL_INDEX = """
SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) - 1 AS DOUBLE) AS idx
FROM (SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang)"""

@job("q_label_index", _LABEL_INDEX)
def q_label_index(spark, sf):
    return LB.label_index(S.documents(spark, sf, ("doc_id", "lang")), "lang")


def _rule_sql(text: str) -> str:
    t = f"(' ' || lower({text}) || ' ')"
    return (f"CASE WHEN contains({t}, ' the ') THEN 'en' "
            f"WHEN contains({t}, ' der ') OR contains({t}, ' die ') THEN 'de' "
            f"WHEN contains({t}, ' el ') OR contains({t}, ' los ') THEN 'es' "
            f"WHEN contains({t}, ' le ') OR contains({t}, ' les ') THEN 'fr' ELSE 'xx' END")


_PRED_IDX = f"""
WITH li AS ({_LABEL_INDEX}),
 r AS (SELECT doc_id, lang, {_rule_sql('text')} AS guess FROM documents)
SELECT r.doc_id, a.idx AS label, coalesce(b.idx, -1.0) AS prediction, r.guess
FROM r JOIN li a ON a.value = r.lang LEFT JOIN li b ON b.value = r.guess"""


def _predictions(spark, sf):
    """{doc_id, label, prediction, guess}: rule guesses indexed like the labels;
    a guess that is no label (a class only predicted) gets index -1."""
    docs = S.documents(spark, sf, ("doc_id", "text", "lang"))
    idx = LB.label_index(docs, "lang")
    g = docs.select("doc_id", "lang", S.rule_language(F.col("text")).alias("guess"))
    a = idx.select(F.col("value").alias("lang"), F.col("idx").alias("label"))
    b = idx.select(F.col("value").alias("guess"), F.col("idx").alias("_pidx"))
    # the label index has one row per class; AQE broadcasts it from its runtime size
    j = g.join(a, "lang").join(b, "guess", "left")
    return j.select("doc_id", "label", F.coalesce("_pidx", F.lit(-1.0)).alias("prediction"), "guess")


@job("q_index_to_label", f"""
WITH p AS ({_PRED_IDX}), li AS ({_LABEL_INDEX})
SELECT p.doc_id, p.prediction, li.value AS predictedLabel FROM p LEFT JOIN li ON li.idx = p.prediction""")
def q_index_to_label(spark, sf):
    p = _predictions(spark, sf)
    idx = LB.label_index(S.documents(spark, sf, ("doc_id", "lang")), "lang")
    return LB.index_to_label(p.select("doc_id", "prediction"), idx)


@job("q_one_vs_other_rows", f"""
WITH r AS ({_INTENT_ROWS}), k AS (SELECT DISTINCT strLabel AS key FROM r WHERE strLabel <> 'Other')
SELECT k.key, r.line_id, r.strLabel FROM r JOIN k ON r.strLabel = k.key OR r.strLabel = 'Other'""")
def q_one_vs_other_rows(spark, sf):
    rows = _intent_rows(spark, sf)
    return LB.one_vs_other(rows.select("line_id", "strLabel"), LB.label_keys(rows))


@job("q_one_vs_rest_rows", """
WITH k AS (SELECT DISTINCT lang AS key FROM documents)
SELECT k.key, d.doc_id, CASE WHEN d.lang = k.key THEN d.lang ELSE 'Other' END AS strLabel
FROM documents d, k""")
def q_one_vs_rest_rows(spark, sf):
    docs = S.documents(spark, sf, ("doc_id", "lang")).withColumnRenamed("lang", "strLabel")
    return LB.one_vs_rest(docs, LB.label_keys(docs))
