"""Jobs for dialogue context, stacking, evaluation, outputs and NLP tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import requests as RQ
from parlance.functions import text as T
from parlance.operators import context as CX
from parlance.operators import evaluate as EV
from parlance.operators import features as FE
from parlance.operators import labels as LB
from parlance.operators import nlp as NLP
from parlance.operators import output as OUT
from parlance.operators import scoring as SC
from parlance.operators import split as SP
from parlance.plans import sources as S
from parlance.plans.jobs import _PRED_IDX, _TURNS, _predictions, _rule_sql, job
from parlance.sources import tables as TB

# ---------------------------------------------------------------- W1 / W2
_KNOWN = "CASE WHEN domain IN ('nba', 'weather') THEN 1 ELSE 0 END"


def _prior_sql(window: str) -> str:
    return f"""
SELECT conv_id, turn,
  CASE WHEN domain IN ('nba', 'weather') THEN sum(CASE WHEN domain = 'nba' THEN 1 ELSE 0 END) OVER w
       / sum({_KNOWN}) OVER w ELSE 0.5 END AS prior_nba,
  CASE WHEN domain IN ('nba', 'weather') THEN sum(CASE WHEN domain = 'weather' THEN 1 ELSE 0 END) OVER w
       / sum({_KNOWN}) OVER w ELSE 0.5 END AS prior_weather
FROM ({_TURNS}) WINDOW w AS ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _prior_cols(df):
    return df.select("conv_id", "turn", F.col("prior")[0].alias("prior_nba"), F.col("prior")[1].alias("prior_weather"))


@job("q_domain_prior", _prior_sql("ORDER BY conv_id, turn"))
def q_domain_prior(spark, sf):
    """Running prior over the whole dialogue file (ungrouped, two-pass)."""
    return _prior_cols(CX.domain_prior(S.turn_domains(spark, sf), ["conv_id", "turn"]))


@job("q_domain_prior_by_conv", _prior_sql("PARTITION BY conv_id ORDER BY turn"))
def q_domain_prior_by_conv(spark, sf):
    return _prior_cols(CX.domain_prior(S.turn_domains(spark, sf), ["turn"], partition_cols=["conv_id"]))


@job("q_previous_task", """
SELECT conv_id, turn, role, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'na') AS previousTask
FROM conversations""")
def q_previous_task(spark, sf):
    conv = TB.read_table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return CX.previous_task(conv, ["conv_id"], ["turn"], "role")


# ---------------------------------------------------------------- T6 / T7 / T8
_TASK_NAME = "concat('dialog.', role, repeat('.', CAST(turn % 3 AS INTEGER)))"


@job("q_last_segment", f"""
SELECT conv_id, turn, task, list_last(CASE WHEN regexp_replace(task, '\\.+$', '') = '' THEN ['']
  ELSE string_split(regexp_replace(task, '\\.+$', ''), '.') END) AS last_task
FROM (SELECT conv_id, turn, {_TASK_NAME} AS task FROM conversations)""")
def q_last_segment(spark, sf):
    conv = TB.read_table(spark, sf, "conversations")
    t = conv.select("conv_id", "turn", F.expr(_TASK_NAME).alias("task"))
    return t.withColumn("last_task", T.last_segment("task"))


_BIAS = """CASE CAST(turn % 4 AS INTEGER) WHEN 0 THEN ''
  WHEN 1 THEN 'nba:0.5,weather:0.5'
  WHEN 2 THEN concat('weather:', CAST(round((conv_id % 10) / 10.0, 1) AS VARCHAR), ',nba:',
                     CAST(round(1 - (conv_id % 10) / 10.0, 1) AS VARCHAR))
  ELSE concat('Weather:0.25,nba:0.75') END"""


@job("q_domain_bias", f"""
SELECT conv_id, turn, bias,
  CASE WHEN bias = '' THEN 0.5 ELSE CAST(split_part(s[1].p, ':', 2) AS DOUBLE) END AS bias_0,
  CASE WHEN bias = '' THEN 0.5 ELSE CAST(split_part(s[2].p, ':', 2) AS DOUBLE) END AS bias_1
FROM (SELECT conv_id, turn, bias,
        list_sort(list_transform(string_split(bias, ','), lambda x: {{'k': lower(x), 'p': x}})) AS s
      FROM (SELECT conv_id, turn, {_BIAS} AS bias FROM conversations))""")
def q_domain_bias(spark, sf):
    conv = TB.read_table(spark, sf, "conversations")
    b = conv.select("conv_id", "turn", F.expr(_BIAS.replace("VARCHAR", "STRING")).alias("bias"))
    w = b.withColumn("_w", T.parse_bias("bias"))
    return w.select("conv_id", "turn", "bias", F.col("_w")[0].alias("bias_0"), F.col("_w")[1].alias("bias_1"))


_REQ = """SELECT conv_id, turn,
  CASE WHEN turn % 5 = 0 THEN NULL ELSE text END AS text,
  CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN 'json' ELSE 'text' END AS type,
  CASE WHEN turn % 4 = 0 THEN NULL ELSE role END AS prevTask,
  CASE WHEN turn % 2 = 0 THEN NULL ELSE 'nba:0.6,weather:0.4' END AS domainBias
FROM conversations"""


@job("q_request_defaults", f"""
SELECT conv_id, turn, coalesce(text, 'Dummy') AS text, coalesce(type, 'text') AS type,
  coalesce(prevTask, 'na') AS prevTask, coalesce(domainBias, '') AS domainBias, CAST(NULL AS VARCHAR) AS domain
FROM ({_REQ})""")
def q_request_defaults(spark, sf):
    conv = TB.read_table(spark, sf, "conversations")
    req = conv.select("conv_id", "turn", "text", "role").selectExpr(
        "conv_id", "turn", "CASE WHEN turn % 5 = 0 THEN NULL ELSE text END AS text",
        "CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN 'json' ELSE 'text' END AS type",
        "CASE WHEN turn % 4 = 0 THEN NULL ELSE role END AS prevTask",
        "CASE WHEN turn % 2 = 0 THEN NULL ELSE 'nba:0.6,weather:0.4' END AS domainBias")
    return RQ.with_request_defaults(req)


# ---------------------------------------------------------------- E1 / E2 / C4
_TASK_INDEX = """SELECT value, CAST(row_number() OVER (ORDER BY n DESC, value) - 1 AS INTEGER) AS idx,
  count(*) OVER () AS k FROM (SELECT previousTask AS value, count(*) AS n FROM t GROUP BY previousTask)"""

_ONE_HOT = f"""
WITH t AS ({_TURNS}), ti AS ({_TASK_INDEX})
SELECT t.conv_id, t.turn, t.previousTask,
  array_to_string(list_transform(range(0, CAST(ti.k - 1 AS INTEGER)),
                  lambda i: CASE WHEN i = ti.idx THEN '1.0' ELSE '0.0' END), ',') AS task_encoded
FROM t JOIN ti ON ti.value = t.previousTask"""


def _task_encoded(spark, sf):
    t = S.turn_labels(spark, sf)
    idx = LB.label_index(t, "previousTask")
    # k = number of distinct previous tasks, carried on every index row (the
    # index has one row per task, so the window is small; AQE picks the join).
    lut = idx.withColumn("k", F.count("*").over(Window.partitionBy()))
    j = t.join(lut.select(F.col("value").alias("previousTask"), "idx", "k"), "previousTask")
    return j.withColumn("taskEncoded", FE.one_hot(F.col("idx").cast("int"), F.col("k").cast("int")))


@job("q_one_hot", _ONE_HOT)
def q_one_hot(spark, sf):
    j = _task_encoded(spark, sf)
    return j.select("conv_id", "turn", "previousTask",
                    F.array_join(F.transform("taskEncoded", lambda x: x.cast("string")), ",").alias("task_encoded"))


def _pseudo_scores_sql(id_col: str, text_col: str, table: str) -> str:
    specs = [("nba", "intentA", 13), ("nba", "intentB", 29),
             ("weather", "intentC", 41), ("weather", "intentD", 53)]
    parts = [f"SELECT {id_col} AS doc_id, '{d}' AS domain, '{c}' AS classifier, "
             f"round(((length({text_col}) * {m} + {id_col}) % 997) / 996.0, 3) AS score FROM {table}"
             for d, c, m in specs]
    return " UNION ALL ".join(parts)


_SCORES = _pseudo_scores_sql("doc_id", "text", "documents")


@job("q_score_vector", f"""
SELECT doc_id, array_to_string(list_transform(list_sort(list({{'d': domain, 'c': classifier, 's': score}})),
                                              lambda e: CAST(e.s AS VARCHAR)), ',') AS classifierFeatures
FROM ({_SCORES}) GROUP BY doc_id""")
def q_score_vector(spark, sf):
    sv = FE.score_vector(S.pseudo_scores(S.documents(spark, sf, ("doc_id", "text"))), ["doc_id"])
    return sv.select("doc_id", F.array_join(F.transform("classifierFeatures", lambda x: x.cast("string")), ",")
                     .alias("classifierFeatures"))


@job("q_assemble", f"""
WITH oh AS ({_ONE_HOT}),
 p AS ({_prior_sql('PARTITION BY conv_id ORDER BY turn')})
SELECT oh.conv_id, oh.turn,
  concat_ws(',', CAST(p.prior_nba AS VARCHAR), CAST(p.prior_weather AS VARCHAR),
            CASE WHEN oh.task_encoded = '' THEN NULL ELSE oh.task_encoded END) AS features
FROM oh JOIN p USING (conv_id, turn)""")
def q_assemble(spark, sf):
    te = _task_encoded(spark, sf)
    pr = CX.domain_prior(te, ["turn"], partition_cols=["conv_id"])
    a = pr.withColumn("features", FE.assemble("prior", "taskEncoded"))
    return a.select("conv_id", "turn", F.array_join(F.transform("features", lambda x: x.cast("string")), ",")
                    .alias("features"))


# ---------------------------------------------------------------- evaluation
_TEST_PRED = f"""
SELECT * FROM ({_PRED_IDX}) WHERE ((('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':11'), 1, 8))::BIGINT) % 100) >= 80"""


def _test_predictions(spark, sf):
    p = _predictions(spark, sf)
    return SP.hash_split(p, "doc_id").filter(~F.col("is_train"))


@job("q_hash_split", """
SELECT doc_id, ((('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':11'), 1, 8))::BIGINT) % 100) < 80 AS is_train
FROM documents""")
def q_hash_split(spark, sf):
    return SP.hash_split(S.documents(spark, sf, ("doc_id",)), "doc_id")


@job("q_confusion", f"""
WITH p AS ({_TEST_PRED}), c AS (SELECT DISTINCT label FROM p)
SELECT a.label, b.label AS prediction, count(p.doc_id) AS n
FROM c a CROSS JOIN c b LEFT JOIN p ON p.label = a.label AND p.prediction = b.label
GROUP BY a.label, b.label""")
def q_confusion(spark, sf):
    return EV.confusion(_test_predictions(spark, sf))


_BY_LABEL = f"""
WITH p AS ({_TEST_PRED}),
 bl AS (SELECT label, count(*) AS n_label, sum(CASE WHEN prediction = label THEN 1 ELSE 0 END) AS tp FROM p GROUP BY label),
 bp AS (SELECT prediction AS label, count(*) AS n_pred FROM p GROUP BY prediction),
 tot AS (SELECT count(*) AS total FROM p),
 m AS (
  SELECT bl.label, bl.n_label, bl.tp, coalesce(bp.n_pred, 0) - bl.tp AS fp,
    CASE WHEN coalesce(bp.n_pred, 0) = 0 THEN 0.0 ELSE bl.tp / bp.n_pred END AS precision,
    bl.tp / bl.n_label AS recall,
    CASE WHEN tot.total - bl.n_label = 0 THEN 'NaN'::DOUBLE ELSE (coalesce(bp.n_pred, 0) - bl.tp) / (tot.total - bl.n_label) END AS fpr
  FROM bl LEFT JOIN bp USING (label) CROSS JOIN tot)
SELECT label, n_label, tp, fp, precision, recall, fpr,
  CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m"""


@job("q_eval_by_label", f"""
SELECT label, n_label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 10) AS precision,
  round(recall, 10) AS recall, round(fpr, 10) AS fpr, round(f1, 10) AS f1 FROM ({_BY_LABEL})""")
def q_eval_by_label(spark, sf):
    return EV.metrics_by_label(_test_predictions(spark, sf))


@job("q_eval_summary", f"""
SELECT n, round(acc, 10) AS accuracy, round(1 - acc, 10) AS test_error,
  round(wp / n, 10) AS weighted_precision, round(wr / n, 10) AS weighted_recall,
  round(wf / n, 10) AS weighted_f1, round(wfpr / n, 10) AS weighted_fpr
FROM (SELECT sum(n_label) AS n, sum(tp) / sum(n_label) AS acc, sum(precision * n_label) AS wp,
        sum(recall * n_label) AS wr, sum(f1 * n_label) AS wf, sum(fpr * n_label) AS wfpr FROM ({_BY_LABEL}))""")
def q_eval_summary(spark, sf):
    return EV.metrics_summary(_test_predictions(spark, sf))


@job("q_score_case", f"""
SELECT doc_id, guess AS predictedLabel, p0,
  CASE WHEN guess = 'Other' THEN 1.0 - p0 WHEN guess = 'en' THEN p0 ELSE 0.0 END AS score
FROM (SELECT doc_id, CASE WHEN g = 'xx' THEN 'Other' ELSE g END AS guess,
        round(((length(text) * 7 + doc_id) % 1000) / 1000.0, 3) AS p0
      FROM (SELECT doc_id, text, {_rule_sql('text')} AS g
            FROM documents))""")
def q_score_case(spark, sf):
    d = S.documents(spark, sf, ("doc_id", "text"))
    g = S.rule_language(F.col("text"))
    t = d.select("doc_id", F.when(g == "xx", F.lit("Other")).otherwise(g).alias("predictedLabel"),
                 F.round(F.pmod(F.length("text") * 7 + F.col("doc_id"), F.lit(1000)) / 1000.0, 3).alias("p0"))
    return t.withColumn("score", SC.score_reference("predictedLabel", "p0", "en"))


@job("q_union_scores", f"SELECT doc_id, domain, classifier, score FROM ({_SCORES})")
def q_union_scores(spark, sf):
    sc = S.pseudo_scores(S.documents(spark, sf, ("doc_id", "text")))
    return SC.union_scores(sc.filter(F.col("domain") == "nba"), sc.filter(F.col("domain") == "weather"))


@job("q_top_scores", f"""
SELECT doc_id, CAST(rank AS INTEGER) AS rank, classifier, score FROM (
  SELECT doc_id, classifier, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, classifier) AS rank
  FROM ({_SCORES})) WHERE rank <= 2""")
def q_top_scores(spark, sf):
    sc = S.pseudo_scores(S.documents(spark, sf, ("doc_id", "text")))
    return SC.top_scores(sc, "doc_id", 2).select("doc_id", "rank", "classifier", "score")


_PAIRS_SQL = f"""SELECT doc_id, list_transform(list_sort(list({{'d': domain, 'c': classifier, 's': score}})),
    lambda e: {{'label': e.c, 'score': e.s}}) AS pairs FROM ({_SCORES}) GROUP BY doc_id"""


@job("q_scores_json", f"""
SELECT doc_id, CAST(to_json({{'domainScores': []::STRUCT(label VARCHAR, score DOUBLE)[], 'intentScores': pairs}}) AS VARCHAR)
  AS response FROM ({_PAIRS_SQL})""")
def q_scores_json(spark, sf):
    sc = S.pseudo_scores(S.documents(spark, sf, ("doc_id", "text")))
    return OUT.format_scores(sc, ["doc_id"], "json")


@job("q_scores_text", f"""
SELECT doc_id, 'List(' || array_to_string(list_transform(pairs, lambda e: '(' || e.label || ',' || CAST(e.score AS VARCHAR) || ')'), ', ')
  || ')' AS response FROM ({_PAIRS_SQL})""")
def q_scores_text(spark, sf):
    sc = S.pseudo_scores(S.documents(spark, sf, ("doc_id", "text")))
    return OUT.format_scores(sc, ["doc_id"], "text")


@job("q_task_json", """
SELECT conv_id, turn, CAST(to_json({'label': role, 'score': 1.0::DOUBLE}) AS VARCHAR) AS response FROM conversations""")
def q_task_json(spark, sf):
    conv = TB.read_table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return OUT.format_task(conv, "role").select("conv_id", "turn", "response")


# ---------------------------------------------------------------- T10 / T11
@job("q_sentences", r"""
SELECT doc_id, CAST(sent_no - 1 AS INTEGER) AS sent_no, sentence FROM (
  SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS sent_no FROM (
    SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+$', ''),
                                               '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s
    FROM documents))""")
def q_sentences(spark, sf):
    return NLP.sentences(S.documents(spark, sf, ("doc_id", "text")), "doc_id", "text")


@job("q_lemmas", r"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[\pL\pN]+'),
  lambda t: CASE t WHEN 'was' THEN 'be' WHEN 'is' THEN 'be' WHEN 'were' THEN 'be' ELSE t END), ' ') AS lemmas
FROM documents""")
def q_lemmas(spark, sf):
    lm = NLP.lemmas(S.documents(spark, sf, ("doc_id", "text")), "doc_id", "text", S.lemma_dictionary(spark))
    return lm.select("doc_id", F.array_join("lemmas", " ").alias("lemmas"))


_PAIRS = ", ".join("('{}', '{}')".format(*x.split(":")) for x in S.INFLECTIONS)


@job("q_lemma_rules", rf"""
WITH pairs AS (SELECT DISTINCT t, m FROM (VALUES {_PAIRS}) v(t, m)),
p AS (SELECT t, m, list_max(list_filter(range(0, least(length(t), length(m)) + 1), lambda i: left(t, i) = left(m, i))) AS same
      FROM pairs),
r AS (SELECT t, length(t) - same AS cut, substring(m, same + 1) AS add FROM p),
e AS (SELECT cut, add, right(t, n) AS suffix FROM (
        SELECT t, cut, add, unnest(range(greatest(cut, 1), least(length(t) - 3, 5) + 1)) AS n FROM r)),
rules AS (SELECT suffix, cut, add FROM (SELECT suffix, cut, add, count(*) AS n FROM e GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY n DESC, cut, add) = 1 AND n >= 2),
known AS (SELECT t AS token, min(m) AS lemma FROM pairs GROUP BY t),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM (
            SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM documents)),
learned AS (
  SELECT token, left(token, length(token) - cut) || add AS lemma FROM (
    SELECT DISTINCT token, suffix, cut, add FROM words JOIN rules
      ON suffix = right(token, length(suffix)) AND length(token) - length(suffix) >= 3)
  QUALIFY row_number() OVER (PARTITION BY token ORDER BY length(suffix) DESC) = 1)
SELECT d.doc_id, coalesce(string_agg(coalesce(k.lemma, l.lemma, w.token), ' ' ORDER BY i), '') AS lemmas
FROM documents d LEFT JOIN words w ON w.doc_id = d.doc_id LEFT JOIN known k ON k.token = w.token
LEFT JOIN learned l ON l.token = w.token GROUP BY d.doc_id""")
def q_lemma_rules(spark, sf):
    """Lemmas by the inline pairs and the suffix rules learned from them."""
    lm = NLP.learned_lemmas(S.documents(spark, sf, ("doc_id", "text")), "doc_id", "text", S.inflections(spark))
    return lm.select("doc_id", F.array_join("lemmas", " ").alias("lemmas"))


@job("q_sentences_counted", r"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '\pL+(?:\.\pL+)*\.?')) AS w FROM documents),
c AS (SELECT CASE WHEN w LIKE '%.' THEN left(w, length(w) - 1) ELSE w END AS type, count(*) AS n,
             count(*) FILTER (w LIKE '%.') AS k FROM w GROUP BY 1),
p AS (SELECT sum(k) / sum(n) AS p FROM c),
f AS (SELECT type, n, k, p, length(type) - length(replace(type, '.', '')) AS dots FROM c, p WHERE k > 0),
abbr AS (
  SELECT type FROM f WHERE -2 * (k * ln(p) + (n - k) * ln(1 - p) - k * ln(0.99) - (n - k) * ln(0.01))
    * exp(-(length(type) - dots)) * (dots + 1) * pow(length(type) - dots, -(n - k)) >= 0.3),
s AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS s FROM (
        SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+$', ''),
                                                   '([.!?])(\s+)', '\1\2' || chr(30), 'g'), chr(30)) AS s FROM documents)),
b AS (
  SELECT doc_id, i, s, CASE
    WHEN lower(regexp_extract(s, '((?:\pL+\.)*\pL+)\.\s*$', 1)) IN (SELECT type FROM abbr) THEN 0
    WHEN regexp_matches(s, '(?:^|[^\pL\pN.])\p{Lu}\.\s+$') THEN 0
    WHEN regexp_matches(s, '\.\.\s+$') AND regexp_matches(coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY i), ''),
                                                            '^\p{Ll}') THEN 0 ELSE 1 END AS ends FROM s),
g AS (SELECT doc_id, i, s, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM b)
SELECT doc_id, CAST(g AS INTEGER) AS sent_no, regexp_replace(string_agg(s, '' ORDER BY i), '\s+$', '') AS sentence
FROM g GROUP BY doc_id, g""")
def q_sentences_counted(spark, sf):
    """Sentences that do not end at the corpus's abbreviations, initials and running ellipses."""
    return NLP.counted_sentences(S.documents(spark, sf, ("doc_id", "text")), "doc_id", "text")
