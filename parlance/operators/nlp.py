"""Sentences and lemmas (T10, T11), re-aimed as table jobs.

The reference calls an NLP library per text on the driver.  Here sentence
splitting and word tokens are regex expressions, and the lemma table is a
dictionary joined on the token.

Two of them learn from tables.  Lemmas of words that no dictionary has follow
suffix rules counted over (token, lemma) pairs; abbreviations, after which no
sentence ends, are found by a log-likelihood test over the whole corpus (Kiss
and Strunk, 2006): a type that nearly always has a period, more than chance
and its length allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators.joins import FEW, few, join_hot
from parlance.operators.slots import BITS, marked_places


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """{id, sent_no, sentence}: split after ., ! or ? plus whitespace.

    Trailing whitespace is dropped first (Java split drops the trailing empty
    sentence).
    """
    stripped = F.regexp_replace(F.col(text_col), T.JAVA_WS + r"+\z", "")
    return (df.select(id_col, T.sentence_split(stripped).alias("_s"))
            .select(id_col, F.posexplode_outer("_s").alias("sent_no", "sentence"))
            .filter(F.col("sentence").isNotNull()))


def _words(c: str) -> Column:
    """The words of a string that has one space between two."""
    return F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def lemmas(df: DataFrame, id_col: str, text_col: str, lemma_dict: DataFrame,
           token_col: str = "token", lemma_col: str = "lemma", bits: int = BITS) -> DataFrame:
    """{id, lemmas}: word tokens of the text in order, each replaced by its lemma.

    The dictionary is joined, whatever its size; a token listed twice has its
    least lemma.  Works on distinct texts, so repeated rows keep their own
    result; a null text gives null, a text without words an empty list.  Only
    tokens that the dictionary may have leave their row, and those that stand
    in very many places are joined by broadcast.  Texts are written and
    shuffled as their words in one string: an array takes several times that.
    """
    rows = df.select(id_col, F.col(text_col).alias("_text"), F.sha2(F.col(text_col), 256).alias("_key"))
    texts = (rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.first("_text").alias("_text"), F.count("*").alias("_rows"))
             .select("_key", F.array_join(T.word_tokens("_text"), " ").alias("_words"), "_rows")).checkpoint()
    cut = texts.select("_key", _words("_words").alias("_t"))
    known = lemma_dict.groupBy(F.col(token_col).alias("token")).agg(F.min(lemma_col).alias("lemma"))
    counts = marked_places(cut, known.select("token"), bits).groupBy("token").agg(F.count("*").alias("n"))
    used = known.join(counts, "token").checkpoint()  # the dictionary's rows that the texts need
    places = marked_places(cut, used.select("token"), bits, "_key")
    if few(used):  # no place is shuffled then
        hits = places.join(F.broadcast(used.drop("n")), "token")
    else:
        hits = join_hot(places, used, "token", "n", used.agg(F.sum("n")).first()[0] or 0, how="inner")
    found = hits.groupBy("_key").agg(
        F.sort_array(F.collect_list(F.struct("j", "lemma"))).alias("_m"))
    j = texts.join(found, "_key", "left").withColumn("_t", _words("_words"))
    tok, m = F.col("_t"), F.col("_m")
    before = F.concat(F.array(F.lit(0)), F.transform(m, lambda x: x["j"]))
    pieces = F.zip_with(m, F.slice(before, 1, F.size(m)), lambda x, b: F.concat(
        F.slice(tok, b + 1, x["j"] - b - 1), F.array(x["lemma"])))
    last = F.element_at(before, -1)
    whole = F.when(m.isNull(), tok).otherwise(F.concat(F.flatten(pieces), F.slice(tok, last + 1, F.size(tok) - last)))
    per = j.select("_key", whole.alias("lemmas"), "_rows")
    return join_hot(rows, per, "_key", "_rows", texts.agg(F.sum("_rows")).first()[0] or 0).select(id_col, "lemmas")


# ---------------------------------------------------------------- lemmas by suffix rules
LONGEST = 5  # characters of a rule's suffix
STEM = 3  # characters that a rule leaves of a token


def suffix_rules(pairs: DataFrame, token_col: str = "token", lemma_col: str = "lemma", least: int = 2) -> DataFrame:
    """{suffix, cut, add}: per token suffix what to cut from its end and add, as most pairs with that suffix have it.

    A pair gives a rule for every suffix of the token that holds what changes,
    up to LONGEST characters; a rule needs ``least`` pairs, ties go to the
    shorter cut.  Pairs that do not change count for rules that change nothing.
    """
    t, m = F.lower(F.col(token_col)), F.lower(F.col(lemma_col))
    p = pairs.where(t.isNotNull() & m.isNotNull() & (t != "")).select(t.alias("t"), m.alias("m")).distinct()
    letters = F.filter(F.sequence(F.lit(0), F.least(F.length("t"), F.length("m"))),
                       lambda i: F.substring("t", 1, i) == F.substring("m", 1, i))
    p = p.withColumn("_same", F.array_max(letters))  # characters that token and lemma begin with alike
    rows = p.select("t", (F.length("t") - F.col("_same")).alias("cut"), F.expr("substring(m, _same + 1)").alias("add"))
    rows = rows.where(F.least(F.length("t") - STEM, F.lit(LONGEST)) >= F.greatest("cut", F.lit(1))).select(
        "cut", "add", F.explode(F.transform(F.sequence(F.greatest("cut", F.lit(1)), F.least(F.length("t") - STEM, F.lit(LONGEST))),
                                            lambda n: F.right("t", n))).alias("suffix"))
    counts = rows.groupBy("suffix", "cut", "add").agg(F.count("*").alias("n"))
    best = counts.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("n"), "cut", "add")).alias("r"))
    return best.where(-F.col("r.n") >= least).select("suffix", "r.cut", "r.add")


def rule_lemmas(tokens: DataFrame, rules: DataFrame, token_col: str = "token") -> DataFrame:
    """{token, lemma} of the distinct ``tokens`` that a rule changes; the rule of the longest suffix decides."""
    t = F.col("token")
    longest = F.least(F.length(t) - STEM, F.lit(LONGEST))
    each = tokens.select(F.col(token_col).alias("token")).distinct().where(longest >= 1).select("token", F.explode(
        F.transform(F.sequence(F.lit(1), longest), lambda n: F.right(t, n))).alias("suffix"))
    if few(rules):
        rules = F.broadcast(rules)
    found = each.join(rules, "suffix").groupBy("token").agg(
        F.max(F.struct(F.length("suffix").alias("n"), "cut", "add")).alias("r"))  # one rule per suffix
    lemma = F.concat(F.expr("substring(token, 1, length(token) - r.cut)"), F.col("r.add"))
    return found.select("token", lemma.alias("lemma")).where("token <> lemma")


def learned_lemmas(df: DataFrame, id_col: str, text_col: str, pairs: DataFrame, least: int = 2) -> DataFrame:
    """{id, lemmas}: as ``lemmas``, but tokens that ``pairs`` (token, lemma) does not have follow its suffix rules.

    Rules are applied to the corpus's distinct tokens, counted with partial sums; the texts are then looked up as in
    ``lemmas``.
    """
    words = df.select(F.explode(T.word_tokens(text_col)).alias("token")).distinct()
    known = pairs.groupBy(F.lower("token").alias("token")).agg(F.min(F.lower("lemma")).alias("lemma"))
    learned = rule_lemmas(words.join(known, "token", "left_anti"), suffix_rules(pairs, least=least).checkpoint())
    return lemmas(df, id_col, text_col, known.unionByName(learned).checkpoint())


# ---------------------------------------------------------------- sentences by corpus counts
TYPE = r"\p{L}+(?:\.\p{L}+)*\.?"  # a word, with inner periods and the one after it
ABBREVIATION = 0.3  # least score
_CUT = "\x1e"


def period_counts(df: DataFrame, text_col: str) -> DataFrame:
    """{type, n, k}: occurrences of each word type, and those with a period after it."""
    found = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"({TYPE})"), 1)).alias("w"))
    per = found.groupBy("w").agg(F.count("*").alias("c"))  # partial sums: a common word is one row per task
    dotted = F.col("w").endswith(".")
    return per.groupBy(F.when(dotted, F.expr("substring(w, 1, length(w) - 1)")).otherwise(F.col("w")).alias("type")).agg(
        F.sum("c").alias("n"), F.sum(F.when(dotted, F.col("c")).otherwise(0)).alias("k"))


def abbreviation_score(n: Column, k: Column, share: Column, kind: Column) -> Column:
    """Log-likelihood of "nearly always a period" (0.99) against the corpus's share, by length, inner periods and
    occurrences without one."""
    rest = n - k
    odds = -2 * (k * F.ln(share) + rest * F.ln(1 - share) - k * F.ln(F.lit(0.99)) - rest * F.ln(F.lit(0.01)))
    periods = F.length(kind) - F.length(F.replace(kind, F.lit("."), F.lit("")))
    length = F.length(kind) - periods
    return odds * F.exp(-length) * (periods + 1) * F.pow(length.cast("double"), -rest.cast("double"))


def abbreviations(df: DataFrame, text_col: str, least: float = ABBREVIATION) -> DataFrame:
    """{type, score}: word types of the corpus that are abbreviations."""
    counts = period_counts(df, text_col).checkpoint()
    total = counts.agg(F.sum("k") / F.sum("n")).first()[0]
    if not total or total >= 1:
        return counts.select("type", F.lit(0.0).alias("score")).limit(0)
    score = abbreviation_score(F.col("n"), F.col("k"), F.lit(float(total)), F.col("type"))
    return counts.where("k > 0").select("type", score.alias("score")).where(F.col("score") >= least)


def counted_sentences(df: DataFrame, id_col: str, text_col: str, least: float = ABBREVIATION, bits: int = BITS) -> DataFrame:
    """{id, sent_no, sentence}: sentences end at ., ! or ? before white space, but not after an abbreviation of the
    corpus, a single capital, or an ellipsis that a small letter follows.

    Works on distinct texts; of a text's pieces only those that end in a type marked as an abbreviation leave their row.
    """
    text = F.regexp_replace(F.col(text_col), T.JAVA_WS + r"+\z", "")
    rows = df.select(id_col, text.alias("_text"), F.sha2(text, 256).alias("_key"))
    texts = rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.first("_text").alias("_text"), F.count("*").alias("_rows"))
    pieces = F.split(F.regexp_replace("_text", r"([.!?])(\s+)", f"$1$2{_CUT}"), _CUT)
    last = F.transform(pieces, lambda s: F.lower(F.regexp_extract(s, r"((?:\p{L}+\.)*\p{L}+)\.\s*\z", 1)))
    texts = texts.select("_key", pieces.alias("_s"), last.alias("_t"), "_rows").checkpoint()
    short = abbreviations(df, text_col, least).select(F.col("type").alias("token")).checkpoint()
    places = marked_places(texts, short, bits, "_key")
    sure = places.join(F.broadcast(short) if few(short, FEW) else short, "token", "left_semi")
    held = sure.groupBy("_key").agg(F.collect_list("j").alias("_held"))
    j = texts.join(held, "_key", "left")
    s = F.col("_s")
    after = F.slice(s, 2, F.size(s))  # the piece after each, none after the last
    # zip_with gives each piece with the one after it; no lambda reads the arrays themselves
    weak = F.transform(F.zip_with(s, after, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: F.coalesce(
        x["a"].rlike(r"(?:^|[^\p{L}\p{N}.])\p{Lu}\.\s+\z") | (x["a"].rlike(r"\.\.\s+\z") & x["b"].rlike(r"^\p{Ll}")),
        F.lit(False)))
    joined = F.array_join(F.transform(F.arrays_zip(s.alias("s"), weak.alias("w")), lambda x, i: F.concat(x["s"], F.when(
        x["w"] | F.array_contains(F.coalesce("_held", F.array().cast("array<int>")), i + 1), "").otherwise(_CUT))), "")
    per = j.select("_key", F.filter(F.split(joined, _CUT), lambda x: x != "").alias("_a"), "_rows")
    total = texts.agg(F.sum("_rows")).first()[0] or 0
    out = join_hot(rows, per, "_key", "_rows", total)
    trimmed = F.transform("_a", lambda x: F.regexp_replace(x, r"\s+\z", ""))
    return out.select(id_col, F.posexplode_outer(F.when(F.size("_a") == 0, F.array(F.lit(""))).otherwise(trimmed))
                      .alias("sent_no", "sentence")).where(F.col("sentence").isNotNull())
