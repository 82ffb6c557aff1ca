"""Edge rows (FIXTURES §3) and differential checks against Spark ML stages."""

import math

from pyspark.ml.feature import NGram, Tokenizer
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import evaluate as EV
from parlance.operators import features as FE
from parlance.operators import slots as SL
from parlance.sources import lines as L

EDGE_TEXTS = [None, "", "   ", "one", "  Hello  World\t ", "of the cat", "a\tb"]


def _rows(spark, values, col="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {col} string")


def test_tokenize_and_ngrams_equal_ml_stages(spark):
    df = _rows(spark, [v for v in EDGE_TEXTS if v is not None] + ["x  y z", "A b. C"])
    ml = NGram(inputCol="words", outputCol="ml_ngrams").transform(
        Tokenizer(inputCol="t", outputCol="words").transform(df)).withColumnRenamed("words", "ml_words")
    ours = FE.ngrams(FE.tokenize(ml, "t"))
    for r in ours.collect():
        assert r["words"] == r["ml_words"], r
        assert r["ngrams"] == r["ml_ngrams"], r


def test_tokenize_null_and_blank(spark):
    out = {r["id"]: r["w"] for r in _rows(spark, EDGE_TEXTS).select("id", T.tokenize("t").alias("w")).collect()}
    assert out[0] is None
    assert out[1] == [""]
    assert out[2] == []
    assert out[3] == ["one"]
    assert out[4] == ["", "", "hello", "", "world"]


def test_hashed_tf_counts_every_bigram(spark):
    df = _rows(spark, ["a b a b a b", "one", "x y"])
    tf = FE.hashed_tf(df, "id", "t", 5000)
    got = {(r["id"], r["bucket"]): r["tf"] for r in tf.collect()}
    assert sum(v for (i, _), v in got.items() if i == 0) == 5
    assert not [k for k in got if k[0] == 1]
    assert sum(v for (i, _), v in got.items() if i == 2) == 1


def test_split_fields_java_rules(spark):
    df = _rows(spark, ["a\tb\t\t", "", "\t\t", "x"], col="value")
    out = {r["id"]: r["p"] for r in df.select("id", T.split_fields("value").alias("p")).collect()}
    assert out == {0: ["a", "b"], 1: [""], 2: [], 3: ["x"]}


def test_parse_utterances_readers(spark):
    df = _rows(spark, ["  hi there \t intent ", "only one field", "a\tb\tc"], col="value")
    strict = {r["id"]: (r["utterance"], r["strLabel"]) for r in
              L.parse_utterances(df, min_fields=2, keep=("id",)).collect()}
    assert strict == {0: ("hi there", "intent"), 2: ("a", "b")}
    loose = {r["id"]: (r["utterance"], r["strLabel"]) for r in
             L.parse_utterances(df, min_fields=1, trim_text=False, keep=("id",)).collect()}
    assert loose[0] == ("  hi there ", "intent") and loose[1] == ("only one field", None)


def test_parse_dictionary_dedup_and_drop_last(spark):
    lines = spark.createDataFrame([("p", 1, "Kobe,Bryant,KB,Mamba"), ("p", 1, "Zed,kb"), ("p", 1, "lonely")],
                                  "slot string, slot_order int, value string")
    full = {r["alias"]: r["canonical"] for r in L.parse_dictionary(lines).collect()}
    assert full == {"bryant": "kobe", "kb": "kobe", "mamba": "kobe"}
    short = {r["alias"] for r in L.parse_dictionary(lines, drop_last_alias=True).collect()}
    assert short == {"bryant", "kb"}


def test_slots_leftmost_longest_and_order(spark):
    dict_lines = spark.createDataFrame(
        [("quantifier", 1, "that,that"), ("preposition", 2, "of,of the,of"), ("preposition", 2, "with,with")],
        "slot string, slot_order int, value string")
    pats = SL.slot_patterns(L.parse_dictionary(dict_lines))
    df = _rows(spark, ["Of the cat, OF course", "that with that", "offset", "", None])
    out = {r["id"]: (r["utterance_slots"], r["n_slots"]) for r in SL.replace_slots(df, "t", pats).collect()}
    assert out[0] == ("preposition cat, preposition course", 2)
    assert out[1] == ("quantifier preposition quantifier", 3)
    assert out[2] == ("offset", 0)
    assert out[3] == ("", 0)


SLOT_TEXTS = ["Of the cat, OF course", "that with that", "offset", "", None, "O'Neal of the of",
              "shaq,shaq of  the", "école of l'été", "of", "i like c++ and .net and that u.s. team",
              "asp.net c++x c+++ c++", "of of the the of", "u.s.u.s. u.s", "that.that-that_that", "\u2028of\u0085"]


def test_slot_join_path_equals_regex_path(spark):
    """Symbols, overlaps, prefixes of each other, repeated ids and rows: both forms agree in full."""
    dict_lines = spark.createDataFrame(
        [("player", 1, "shaquille,o'neal,shaq"), ("quantifier", 2, "that,that,that one"),
         ("preposition", 3, "of,of the,of"), ("preposition", 3, "with,with"),
         ("tech", 4, "lang,c++,.net,c"), ("place", 5, "usa,u.s.,u.s")],
        "slot string, slot_order int, value string")
    d = L.parse_dictionary(dict_lines)
    values = [*enumerate(SLOT_TEXTS), (7, "that one"), (7, "that one"), (7, "that")]
    df = spark.createDataFrame(values, "id int, t string")
    pick = lambda out: sorted(map(str, out.select("id", "t", "utterance_slots", "n_slots").collect()))
    regex = SL.replace_slots(df, "t", SL.slot_patterns(d)).withColumn(
        "n_slots", F.when(F.col("t").isNotNull(), F.col("n_slots")))
    joined = SL.replace_slots_join(df, "t", d)
    assert pick(regex) == pick(joined)
    by = {r["id"]: (r["utterance_slots"], r["n_slots"]) for r in joined.collect()}
    assert by[5] == ("player preposition preposition", 3)
    assert by[9] == ("i like tech and tech and quantifier place team", 4)


def test_last_segment_and_bias(spark):
    df = _rows(spark, ["a.b.c", "a.", "na", ""])
    seg = {r["id"]: r["s"] for r in df.select("id", T.last_segment("t").alias("s")).collect()}
    assert seg == {0: "c", 1: "a", 2: "na", 3: ""}
    b = _rows(spark, ["", None, "weather:0.2,nba:0.8", "nba:0.5,weather:0.5"])
    bias = {r["id"]: r["w"] for r in b.select("id", T.parse_bias("t").alias("w")).collect()}
    assert bias == {0: [0.5, 0.5], 1: [0.5, 0.5], 2: [0.8, 0.2], 3: [0.5, 0.5]}


def test_malformed_bias_is_default_and_marked(spark):
    df = _rows(spark, ["nba", "nba:x,weather:1", "nba:0.5", "nba:1,weather:2,x:3", ",", "nba:0.1,weather:0.9", ""])
    out = {r["id"]: (r["w"], r["e"]) for r in
           df.select("id", T.parse_bias("t").alias("w"), T.bias_error("t").alias("e")).collect()}
    assert {k for k, (_, e) in out.items() if e} == {0, 1, 2, 3, 4}
    assert all(out[k][0] == [0.5, 0.5] for k in (0, 1, 2, 3, 4, 6)) and out[5][0] == [0.1, 0.9]


def test_line_separators_are_not_line_ends(spark):
    """A final U+0085, U+2028 or U+2029 is an ordinary character for trim, split and tokens."""
    for end in ("\u0085", "\u2028", "\u2029"):
        df = spark.createDataFrame([(f"hello world {end}",), (f" a b {end}",)], "t string")
        ml = Tokenizer(inputCol="t", outputCol="words").transform(df).collect()
        ours = df.select("t", T.tokenize("t").alias("w")).collect()
        assert [r["words"] for r in ml] == [r["w"] for r in ours]
        trimmed = df.select(T.java_trim("t").alias("x")).collect()
        assert [r["x"] for r in trimmed] == [f"hello world {end}", f"a b {end}"]
        assert df.select(T.split_fields(F.lit(f"x\t\t{end}")).alias("p")).first()["p"] == ["x", "", end]


def test_confusion_of_many_classes(spark):
    """1,000 classes within seconds: the work is linear in the pairs and the grid."""
    n = 1000
    df = spark.range(5 * n).select((F.col("id") % n).cast("double").alias("label"),
                                   ((F.col("id") * 7) % n).cast("double").alias("prediction"))
    assert EV.confusion(df).agg(F.count("*"), F.sum("n")).first() == (n * n, 5 * n)
    assert EV.metrics_by_label(df).count() == n


def test_metrics_edge_rules(spark):
    # class 2 only predicted; class 1 never predicted
    pairs = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (1.0, 0.0), (1.0, 2.0), (0.0, 0.0)],
                                  "label double, prediction double")
    by = {r["label"]: r for r in EV.metrics_by_label(pairs).collect()}
    assert set(by) == {0.0, 1.0}
    assert by[1.0]["precision"] == 0.0 and by[1.0]["recall"] == 0.0 and by[1.0]["f1"] == 0.0
    assert by[0.0]["tp"] == 2 and by[0.0]["fp"] == 1
    conf = {(r["label"], r["prediction"]): r["n"] for r in EV.confusion(pairs).collect()}
    assert conf == {(0.0, 0.0): 2, (0.0, 1.0): 0, (1.0, 0.0): 1, (1.0, 1.0): 0}
    single = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0)], "label double, prediction double")
    s = EV.metrics_by_label(single).collect()
    assert len(s) == 1 and math.isnan(s[0]["fpr"])


def test_metrics_equal_mllib(spark):
    from pyspark.mllib.evaluation import MulticlassMetrics
    data = [(float(i % 3), float((i * 7) % 4 % 3)) for i in range(200)]
    df = spark.createDataFrame(data, "prediction double, label double")
    m = MulticlassMetrics(df.rdd.map(tuple))
    s = EV.metrics_summary(df).first()
    assert abs(s["accuracy"] - m.accuracy) < 1e-9
    assert abs(s["weighted_precision"] - m.weightedPrecision) < 1e-9
    assert abs(s["weighted_recall"] - m.weightedRecall) < 1e-9
    assert abs(s["weighted_f1"] - m.weightedFMeasure()) < 1e-9
    for r in EV.metrics_by_label(df).collect():
        assert abs(r["precision"] - m.precision(r["label"])) < 1e-9
        assert abs(r["recall"] - m.recall(r["label"])) < 1e-9
        assert abs(r["fpr"] - m.falsePositiveRate(r["label"])) < 1e-9


def test_lemmas(spark):
    """Null texts, repeated ids and rows, and tokens listed twice."""
    from parlance.operators import nlp as NLP
    lem = spark.createDataFrame([("was", "be"), ("is", "be"), ("were", "be"), ("cats", "cat"), ("cats", "zebra")],
                                "token string, lemma string")
    rows = [(0, "It was. Cats is here!"), (1, ""), (2, "WERE were?"), (2, "WERE were?"), (2, "cats"), (3, None),
            (4, "été était")]
    got = sorted(map(str, NLP.lemmas(spark.createDataFrame(rows, "id int, t string"), "id", "t", lem).collect()))
    want = [(0, ["it", "be", "cat", "be", "here"]), (1, []), (2, ["be", "be"]), (2, ["be", "be"]), (2, ["cat"]),
            (3, None), (4, ["été", "était"])]
    assert got == sorted(f"Row(id={i}, lemmas={x})" for i, x in want)
