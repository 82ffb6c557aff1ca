"""Dictionary tables by anchors, and joins and ranks without hot keys."""

import random
import re

from pyspark.sql import functions as F

from parlance.operators import joins as J
from parlance.operators import labels as LB
from parlance.operators import nlp as NLP
from parlance.operators import slots as SL

DICT = "slot string, slot_order int, alias string, canonical string"


def both_forms(spark, texts, aliases, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(5)
    d = spark.createDataFrame([(s, o, a, a) for s, o, a in aliases], DICT)
    by_join = SL.replace_slots_join(df, "text", d, **options)
    by_regex = SL.replace_slots(df, "text", SL.slot_patterns(d))
    rows = lambda x: sorted((r["id"], r["utterance_slots"], r["n_slots"]) for r in x.collect())
    return rows(by_join), rows(by_regex)


def test_anchors_equal_the_regex_form(spark):
    """Random texts and aliases over few words: overlaps, symbols, repeated words, aliases of every length."""
    rng = random.Random(4)
    words = ["new", "york", "city", "of", "the", "c++", ".net", "a-b", "New", "été", "x", "_y", "9"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "-", ".", "", ", ", "\n"]) for _ in range(rng.randrange(14)))
             for _ in range(150)] + [None, "", " ", "of of of the the", "c++c++", "york", "york"]
    aliases = [("PLACE", 1, "new york"), ("PLACE", 1, "new york city"), ("PLACE", 1, "york"), ("PLACE", 1, "never seen"),
               ("B-LANG", 2, "c++"), ("B-LANG", 2, ".net"), ("B-LANG", 2, "of the"), ("x y", 3, "place of"), ("x y", 3, "+"),
               ("last", 4, "x y"), ("last", 4, "of of")]
    got, want = both_forms(spark, texts, aliases)
    assert got == want
    assert both_forms(spark, texts, aliases, bits=64)[0] == want  # marks that tell hardly any token from others


def test_an_alias_goes_under_its_rarest_word(spark):
    texts = spark.createDataFrame([(str(i), ["the", " ", "rare"] if i == 7 else ["the", " ", "x"]) for i in range(20)],
                                  "_key string, _t array<string>")
    aliases = spark.createDataFrame([(["the", " ", "rare"],), (["the"],), (["unseen", " ", "the"],)], "_a array<string>")
    got = {r["token"]: (r["n"], [(x["off"], x["a"]) for x in r["aliases"]]) for r in SL.anchors(texts, aliases).collect()}
    assert got == {"rare": (1, [(2, ["the", " ", "rare"])]), "the": (20, [(0, ["the"])])}


def test_only_anchors_leave_their_row(spark):
    """A word that every text has, and that no alias is anchored at, is never exploded."""
    texts = spark.createDataFrame([(str(i), ["the", " ", "the", " ", f"w{i}"]) for i in range(30)], "_key string, _t array<string>")
    anchors = spark.createDataFrame([("w3",), ("w4",)], "token string")
    got = SL.marked_places(texts, anchors, SL.BITS, "_key").collect()
    assert sorted((r["_key"], r["j"], r["token"]) for r in got) == [("3", 5, "w3"), ("4", 5, "w4")]


def test_a_word_in_every_text_is_not_shuffled(spark):
    """Its places are joined by broadcast: no exchange on the token above them."""
    left = spark.createDataFrame([(i, "hot" if i % 10 else f"w{i}") for i in range(2000)], "id long, token string")
    right = spark.createDataFrame([("hot", 1800, "H"), ("w10", 1, "L")], "token string, n long, lemma string")
    out = J.join_hot(left, right, "token", "n", 2000, how="inner")
    assert sorted(r["lemma"] for r in out.collect()) == ["H"] * 1800 + ["L"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = J.join_hot(left, right, "token", "n", 2000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 3 and plan.count("SortMergeJoin") == 1  # marks twice, hot rows; the rest


def test_lemmas_of_hot_and_missing_tokens(spark):
    d = spark.createDataFrame([("was", "be"), ("is", "be"), ("is", "zz"), ("mice", "mouse")], "token string, lemma string")
    df = spark.createDataFrame([(1, "The mice IS here, was it?"), (2, None), (3, "..."), (4, "is is"), (4, "is is"), (5, "none")],
                               "id long, text string")
    got = sorted((r["id"], r["lemmas"]) for r in NLP.lemmas(df, "id", "text", d).collect())
    assert got == [(1, ["the", "mouse", "be", "here", "be", "it"]), (2, None), (3, []), (4, ["be", "be"]), (4, ["be", "be"]),
                   (5, ["none"])]


def test_rank_has_no_window_over_all_rows(spark):
    df = spark.range(5000).select(F.concat(F.lit("w"), F.pmod(F.xxhash64("id"), F.lit(700))).alias("strLabel"))
    index = LB.label_index(df)
    got = {r["value"]: (r["n"], r["idx"]) for r in index.collect()}
    order = sorted(got, key=lambda v: (-got[v][0], v))
    assert [got[v][1] for v in order] == [float(i) for i in range(len(order))]
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "value" not in "".join(re.findall(r"Window.*", plan))  # the only window is over one row per partition


def test_rank_of_no_rows(spark):
    assert LB.label_index(spark.createDataFrame([], "strLabel string")).collect() == []


# ---------------------------------------------------------------- learned lemmas and sentences
def test_suffix_rules_reach_unseen_inflections(spark):
    from parlance.plans import sources as S
    rules = {r["suffix"]: (r["cut"], r["add"]) for r in NLP.suffix_rules(S.inflections(spark)).collect()}
    assert rules["ing"] == (3, "") and rules["ies"] == (3, "y") and rules["ied"] == (3, "y")
    df = spark.createDataFrame([(1, "He jumped, hurries, and wrapping berries; was bringing this king."), (2, None), (3, "")],
                               "id long, text string")
    got = {r["id"]: r["lemmas"] for r in NLP.learned_lemmas(df, "id", "text", S.inflections(spark)).collect()}
    assert got[1] == ["he", "jump", "hurry", "and", "wrapp", "berry", "was", "bring", "this", "king"]
    assert got[2] is None and got[3] == []


def test_longest_suffix_and_exact_pairs_win(spark):
    pairs = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("wishes", "wish"), ("dishes", "dish"), ("news", "news"),
                                   (None, "x"), ("x", None)], "token string, lemma string")
    df = spark.createDataFrame([(1, "birds fishes news cats xs")], "id long, text string")
    assert NLP.learned_lemmas(df, "id", "text", pairs).first()["lemmas"] == ["bird", "fish", "news", "cat", "xs"]
    none = pairs.limit(0)
    assert NLP.learned_lemmas(df, "id", "text", none).first()["lemmas"] == ["birds", "fishes", "news", "cats", "xs"]


def test_sentences_by_corpus_counts(spark):
    texts = ["Dr. Smith saw 3.5 cats. They ran... and hid. J. Doe left!  Then, e.g. at noon, it rained. Was it? Yes.",
             "We met Dr. Jones, e.g. today. The end", "Ask Dr. No. One. Two.", "The cats ran. A dog hid. The end came.",
             "He saw dr. who. It was etc. and so on, e.g. this.", None, "", "no end", "  spaced .  out. "]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, texts[1])], "id long, text string")
    got = {}
    for r in NLP.counted_sentences(df, "id", "text").orderBy("id", "sent_no").collect():
        got.setdefault(r["id"], []).append(r["sentence"])
    assert got[0] == ["Dr. Smith saw 3.5 cats.", "They ran... and hid.", "J. Doe left!", "Then, e.g. at noon, it rained.",
                      "Was it?", "Yes."]
    assert got[1] == got[99] == ["We met Dr. Jones, e.g. today.", "The end"]
    assert got[2][0].startswith("Ask Dr. No.") and got[3] == ["The cats ran.", "A dog hid.", "The end came."]
    assert 5 not in got and got[6] == [""] and got[7] == ["no end"] and got[8] == ["  spaced .", "out."]


def test_lemmas_of_a_large_dictionary_equal_those_of_a_small_one(spark, monkeypatch):
    """Broadcast or joined by key, the same rows; texts without words, null and repeated ones keep theirs."""
    rows = [(1, "Was it? It WAS."), (2, ""), (3, None), (4, "... !"), (5, "Été  était\nwas"), (6, "Was it? It WAS."), (7, "none here")]
    df = spark.createDataFrame(rows, "id int, t string")
    lem = spark.createDataFrame([("was", "be"), ("était", "être"), ("it", "a b"), ("none", None)], "token string, lemma string")
    want = [(1, ["be", "a b", "a b", "be"]), (2, []), (3, None), (4, []), (5, ["été", "être", "be"]),
            (6, ["be", "a b", "a b", "be"]), (7, [None, "here"])]
    for limit in (NLP.FEW, 0):
        monkeypatch.setattr(NLP, "few", lambda table, most=limit: table.limit(most + 1).count() <= most)
        got = NLP.lemmas(df, "id", "t", lem)
        assert sorted((r["id"], r["lemmas"]) for r in got.collect()) == want


def test_texts_of_lemmas_are_written_as_strings(spark, monkeypatch):
    """What is written and shuffled of a text is one string, not an array of its words."""
    from parlance.plans import sources as S
    kept, real = [], type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda d, *a: kept.append(d.schema) or real(d, *a))
    NLP.lemmas(spark.createDataFrame([(1, "it was")], "id int, t string"), "id", "t", S.lemma_dictionary(spark)).collect()
    assert kept and not any("array" in f.dataType.simpleString() for schema in kept for f in schema)


def test_marked_places_are_a_compiled_filter(spark):
    """No lambda runs token by token; places are right for few bits too, and a text without tokens has none."""
    texts = spark.createDataFrame([("k", ["a", " ", "b", "a", "é"]), ("n", []), ("m", None)], "_key string, _t array<string>")
    tokens = spark.createDataFrame([("a",), ("é",)], "token string")
    got = SL.marked_places(texts, tokens, 1 << 20, "_key")
    assert got.columns == ["_key", "j", "token"]
    assert sorted(map(tuple, got.collect())) == [("k", 1, "a"), ("k", 4, "a"), ("k", 5, "é")]
    few = {tuple(r) for r in SL.marked_places(texts, tokens, 64, "_key").collect()}
    assert {("k", 1, "a"), ("k", 4, "a"), ("k", 5, "é")} <= few <= {("k", i + 1, t) for i, t in enumerate(["a", " ", "b", "a", "é"])}
    assert "filter(transform(_t" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_slots_are_written_once_and_not_shuffled_again(spark, monkeypatch):
    """Of each slot only the places of its picks are written, as numbers; no array of a text's tokens is."""
    kept, real = [], type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda d, *a: kept.append(d.schema) or real(d, *a))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    df = spark.createDataFrame([(1, "This cat of the house"), (2, "that of that"), (2, "that of that"), (3, None), (4, "")],
                               "id int, text string")
    d = spark.createDataFrame([("q", 1, "this", "this"), ("q", 1, "that", "that"), ("p r", 2, "of", "of"),
                               ("p r", 2, "of the", "of"), ("last", 3, "r q", "r")], DICT)
    out = SL.replace_slots_join(df, "text", d)
    texts = [s for s in kept if "text" in s.names]
    assert len(texts) == 1 and texts[0].names == ["id", "text", "_key"]
    assert not any(f.dataType.simpleString() == "array<string>" for s in kept for f in s)
    assert sum(s.names == ["_key", "_at", "_len"] for s in kept) == 3  # the picks of a slot
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive
    assert sorted((r["id"], r["utterance_slots"], r["n_slots"]) for r in out.collect()) == [
        (1, "q cat p r house", 2), (2, "q p last", 4), (2, "q p last", 4), (3, None, None), (4, "", 0)]


def test_slots_of_a_large_dictionary_equal_those_of_a_small_one(spark, monkeypatch):
    """Aliases broadcast, or places joined by token: the same rows, picks of names that earlier slots put in included."""
    texts = ["that of the u.s. of that", "of the the of c++", None, "", "one of one", "that that that"] * 3
    aliases = [("x y", 1, "that"), ("x y", 1, "one"), ("b", 2, "of"), ("b", 2, "of the"), ("b", 2, "c++"), ("c", 3, "y b"),
               ("c", 3, "u.s."), ("d", 4, "x"), ("e", 5, "unseen")]
    for limit in (SL.FEW, 0):
        monkeypatch.setattr(SL, "FEW", limit)
        got, want = both_forms(spark, texts, aliases)
        assert got == want
