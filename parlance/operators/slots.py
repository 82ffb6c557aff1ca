"""Slot replacement (T5, A9, J2): dictionary aliases -> slot names.

Semantics (decisions Q1-Q6): the text is lower-cased; each slot's
dictionary is applied in ``slot_order`` and sees the output of the previous
one; matches are whole words (no letter, digit or ``_`` on either side),
leftmost-longest and non-overlapping; a text with no dictionary stays as is.

Two forms with the same results, chosen by what the dictionary is, not by its
size: a dictionary given as a parameter (inline) becomes one regular expression
per slot (longest alias first, so the alternation is leftmost-longest),
evaluated by Spark's JVM regex engine inside the projection -- no join, no
shuffle; a dictionary that is a table is joined (``replace_slots_join``) and
never gathered.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.joins import FEW, join_hot, kept_by_key

# Word characters for whole-word matching.
WORD = r"\p{L}\p{N}_"


def slot_patterns(dictionary: DataFrame, slot_col: str = "slot", order_col: str = "slot_order",
                  alias_col: str = "alias") -> list[tuple[str, str]]:
    """[(slot, pattern)] in application order; aliases sorted longest first.

    For inline dictionaries, whose rows come from the driver anyway.
    """
    rows = (dictionary.groupBy(slot_col, order_col)
            .agg(F.collect_set(alias_col).alias("aliases"))
            .orderBy(order_col, slot_col).collect())
    out = []
    for r in rows:
        aliases = sorted({a for a in r["aliases"] if a}, key=lambda a: (-len(a), a))
        if not aliases:
            continue
        alt = "|".join(re.escape(a) for a in aliases)
        out.append((r[slot_col], alt))
    return out


def _java_pattern(alt: str) -> str:
    return f"(?<![{WORD}])(?:{alt})(?![{WORD}])"


def replace_slots(df: DataFrame, text_col: str, patterns: Sequence[tuple[str, str]],
                  out_text: str = "utterance_slots", out_count: str = "n_slots") -> DataFrame:
    """Adds the slot-replaced text and the number of replaced aliases.

    Each slot is one projection step (its count is taken on the text the
    previous slots produced), so the regex of a slot runs once per row.
    """
    cur = "_slot_t0"
    out = df.withColumn(cur, F.lower(F.col(text_col))).withColumn("_slot_n", F.lit(0))
    for i, (slot, alt) in enumerate(patterns, start=1):
        pat = _java_pattern(alt)
        nxt = f"_slot_t{i}"
        out = (out.withColumn("_slot_n", F.col("_slot_n") + F.regexp_count(F.col(cur), F.lit(pat)))
               .withColumn(nxt, F.regexp_replace(F.col(cur), pat, slot.replace("\\", "\\\\").replace("$", "\\$")))
               .drop(cur))
        cur = nxt
    return (out.withColumnRenamed(cur, out_text)
            .withColumnRenamed("_slot_n", out_count)
            .withColumn(out_count, F.col(out_count).cast("int")))


def slot_counts(df: DataFrame, id_col: str, text_col: str,
                patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """{id, slot, n}: per text and slot, aliases replaced by that slot."""
    cur = "_slot_t0"
    out = df.select(id_col, F.lower(F.col(text_col)).alias(cur))
    counts: list[Column] = []
    for i, (slot, alt) in enumerate(patterns, start=1):
        pat = _java_pattern(alt)
        out = out.withColumn(f"_n{i}", F.regexp_count(F.col(cur), F.lit(pat)))
        out = out.withColumn(f"_slot_t{i}", F.regexp_replace(F.col(cur), pat, slot)).drop(cur)
        cur = f"_slot_t{i}"
        counts.append(F.struct(F.lit(slot).alias("slot"), F.col(f"_n{i}").cast("int").alias("n")))
    return out.select(id_col, F.inline_outer(F.array(*counts)))


def find_entities(df: DataFrame, id_col: str, text_col: str, dictionary: DataFrame,
                  patterns: Sequence[tuple[str, str]], slot_col: str = "slot",
                  alias_col: str = "alias", canonical_col: str = "canonical") -> DataFrame:
    """{id, slot, match_no, alias, canonical}: the dictionary lookup.

    Matches are extracted per slot in order (as replacement sees them) and
    joined to the dictionary on (slot, alias).  The dictionary side is small
    and AQE turns the join into a broadcast from its runtime size.
    """
    cur = "_slot_t0"
    out = df.select(id_col, F.lower(F.col(text_col)).alias(cur))
    parts = []
    for i, (slot, alt) in enumerate(patterns, start=1):
        pat = _java_pattern(alt)
        out = out.withColumn(f"_m{i}", F.regexp_extract_all(F.col(cur), F.lit(f"({pat})"), 1))
        out = out.withColumn(f"_slot_t{i}", F.regexp_replace(F.col(cur), pat, slot)).drop(cur)
        cur = f"_slot_t{i}"
        parts.append(F.struct(F.lit(slot).alias(slot_col), F.col(f"_m{i}").alias("_ms")))
    exploded = (out.select(id_col, F.inline_outer(F.array(*parts)))
                .select(id_col, slot_col, F.posexplode_outer("_ms").alias("match_no", alias_col))
                .filter(F.col(alias_col).isNotNull()))
    d = dictionary.select(slot_col, alias_col, canonical_col)
    return exploded.join(d, [slot_col, alias_col], "left")


# ---------------------------------------------------------------- dictionary tables
_TOKENS = rf"[{WORD}]++|[^{WORD}]"  # a whole word, or one other character
_WORDS = rf"[{WORD}]++"
_IS_WORD = rf"^[{WORD}]"
BITS = 1 << 20  # bits of the marks that texts' tokens are held against


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKENS), 0)


def _marks(tokens: DataFrame, bits: int) -> Column:
    """Bits of the tokens in ``tokens`` (token) as an array of longs: a scalar subquery of a fixed size."""
    place = F.pmod(F.xxhash64("token"), F.lit(bits))
    words = tokens.select(F.floor(place / 64).cast("long").alias("id"), F.pmod(place, F.lit(64)).alias("bit")).groupBy("id") \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("word"))
    every = tokens.sparkSession.range(bits // 64).join(words, "id", "left").select(
        "id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda s: s["word"])).scalar()


def _is_marked(token: Column, marks: Column, bits: int) -> Column:
    place = F.pmod(F.xxhash64(token), F.lit(bits))
    word = F.get(marks, F.floor(place / 64).cast("int"))
    return F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1


def marked_places(texts: DataFrame, tokens: DataFrame, bits: int, *also: str) -> DataFrame:
    """{j, token, also...}: the positions (from 1) of the texts' tokens that are marked for ``tokens``.

    Unmarked tokens are dropped in the stage that explodes them, before anything is shuffled.  Every token of every
    text comes by here, so it is a compiled filter on exploded rows: a lambda is interpreted token by token.
    """
    marked = texts.withColumn("_marks", _marks(tokens, bits))
    # outer: else a filter on the array's size is pushed below what makes it, which makes it twice
    each = marked.select(*also, "_marks", F.posexplode_outer("_t").alias("j", "token"))
    return each.where(F.col("token").isNotNull() & _is_marked(F.col("token"), F.col("_marks"), bits)).select(
        *also, (F.col("j") + 1).alias("j"), "token")


def _cut(aliases: DataFrame) -> DataFrame:
    """{_a, _alias, token}: the distinct tokens an alias may be anchored at, words where it has any."""
    words = F.filter("_a", lambda t: t.rlike(_IS_WORD))
    return aliases.select("_a", F.xxhash64("_a").alias("_alias"), F.explode(F.array_distinct(
        F.when(F.size(words) > 0, words).otherwise(F.col("_a")))).alias("token"))


def token_counts(texts: DataFrame, aliases: DataFrame, bits: int = BITS) -> DataFrame:
    """{token, n}: how often each token of ``aliases`` stands in the texts; some others that share a mark come along."""
    tokens = _cut(aliases).select("token").distinct()
    return (marked_places(texts, tokens, bits).groupBy("token").agg(F.count("*").alias("n"))
            .checkpoint())  # a row per token of the dictionary


def _counts(texts: DataFrame, aliases: DataFrame, bits: int) -> DataFrame:
    """``token_counts`` of uncut texts (``_low``); only their words are cut out where no alias is anchored at another token."""
    words = _cut(aliases).where(~F.col("token").rlike(_IS_WORD)).isEmpty()
    cut = F.regexp_extract_all("_low", F.lit(_WORDS), 0) if words else _tokens(F.col("_low"))
    return token_counts(texts.select(cut.alias("_t")), aliases, bits)


def anchors(texts: DataFrame, aliases: DataFrame, bits: int = BITS, counts: DataFrame | None = None) -> DataFrame:
    """{token, n, aliases}: each alias under its rarest token in the texts, with the token's number of places.

    ``aliases`` has the tokens of an alias (``_a``), ``texts`` those of a
    text (``_t``).  Only words are counted where an alias has any, and only
    tokens that some alias has.  An alias with a word that no text has cannot
    match and has no anchor.  An entry of ``aliases`` is the alias and the
    anchor's offset in it.  ``counts`` are those of ``token_counts`` or more,
    if they are known; then the texts are not read.
    """
    cut = _cut(aliases)
    if counts is None:
        counts = token_counts(texts, aliases, bits)
    per = cut.join(counts, "token", "left").groupBy("_alias", "_a").agg(
        F.min(F.struct("n", "token")).alias("rare"), F.count("*").alias("words"), F.count("n").alias("known"))
    found = per.where("words = known").select(F.col("rare.token").alias("token"), F.col("rare.n").alias("n"), F.struct(
        (F.array_position("_a", F.col("rare.token")) - 1).cast("int").alias("off"), F.col("_a").alias("a")).alias("alias"))
    return found.groupBy("token", "n").agg(F.collect_list("alias").alias("aliases")).checkpoint()


def alias_matches(texts: DataFrame, aliases: DataFrame, bits: int = BITS, counts: DataFrame | None = None) -> DataFrame:
    """{_key, j, len}: the places in the texts' tokens where an alias stands as whole words.

    Only places of anchors are joined with the aliases; a few aliases, and of
    more the anchors that stand in very many places, are joined by broadcast,
    so a word in every text is not shuffled at all.  What is compared is the
    tokens around the place.
    """
    by_token = anchors(texts, aliases, bits, counts)
    most = by_token.agg(F.sum("n").alias("n"), F.max(F.array_max(F.transform("aliases", lambda x: F.size(x["a"]))))
                        .alias("len"), F.sum(F.size("aliases")).alias("aliases")).first()
    if not most["n"]:
        return texts.select("_key", F.lit(0).alias("j"), F.lit(0).alias("len")).limit(0)
    reach = most["len"]
    spots = marked_places(texts, by_token.select("token"), bits, "_key", "_t")
    around = spots.select("_key", "j", "token", F.slice("_t", F.greatest(F.col("j") - reach, F.lit(1)), 2 * reach + 1)
                          .alias("_near"), F.least(F.col("j"), F.lit(reach + 1)).alias("_at"))
    if most["aliases"] <= FEW:  # one pass over the texts, and no place is shuffled
        maybe = around.join(F.broadcast(by_token.drop("n")), "token")
    else:
        maybe = join_hot(around, by_token, "token", "n", most["n"], how="inner")
    each = maybe.select("_key", "j", "_near", "_at", F.explode("aliases").alias("x")).select(
        "_key", "_near", (F.col("j") - F.col("x.off")).alias("j"), (F.col("_at") - F.col("x.off")).alias("_from"),
        F.col("x.a").alias("_a"))
    near = F.col("_near")

    def word_at(i: Column) -> Column:
        return F.coalesce(F.get(near, i - 1).rlike(_IS_WORD), F.lit(False))

    start, length = F.col("_from"), F.size("_a")
    # the same tokens, and no word directly before or after one: as whole-word matching has it
    fits = (start >= 1) & (F.slice(near, F.greatest(start, F.lit(1)), length) == F.col("_a"))
    return each.where(fits & ~word_at(start - 1) & ~word_at(start + length)).select("_key", "j", length.alias("len"))


def _picks(matches: DataFrame) -> DataFrame:
    """{_key, _at, _len}: per text the matches that are replaced: leftmost, then longest, none overlapping.

    Two arrays of ints, as an array of structs takes four times that.
    """
    found = matches.groupBy("_key").agg(F.collect_set(F.struct("j", (-F.col("len")).alias("neg_len"))).alias("_m"))
    # greedy non-overlapping pick in one pass over the sorted matches
    init = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<j:int,len:int>>").alias("picked"))
    picked = F.aggregate(
        F.sort_array("_m"), init,
        lambda acc, m: F.when(m["j"] > acc["end"], F.struct(
            (m["j"] - m["neg_len"] - 1).alias("end"),
            F.concat(acc["picked"], F.array(F.struct(m["j"].alias("j"), (-m["neg_len"]).alias("len")))).alias("picked")))
        .otherwise(acc),
        lambda acc: acc["picked"])
    return found.select("_key", picked.alias("_p")).select(
        "_key", F.transform("_p", lambda x: x["j"]).alias("_at"), F.transform("_p", lambda x: x["len"]).alias("_len"))


def _replaced(tok: Column, at: Column, size: Column, name: Sequence[str]) -> Column:
    """A text's tokens with the tokens ``name`` for each pick (``size`` tokens from ``at``); null picks are none."""
    name = F.array(*map(F.lit, name)).cast("array<string>")
    prev_end = F.concat(F.array(F.lit(0)), F.zip_with(at, size, lambda a, n: a + n - 1))
    # zip_with pads the shorter side with nulls: pair each span with its own gap start
    pieces = F.zip_with(at, F.slice(prev_end, 1, F.size(at)), lambda a, pe: F.concat(
        F.slice(tok, pe + 1, a - pe - 1), name))
    last_end = F.element_at(prev_end, -1)
    tail = F.slice(tok, last_end + 1, F.size(tok) - last_end)
    return F.when(at.isNull(), tok).otherwise(F.concat(F.flatten(pieces), tail))


def replace_slots_join(df: DataFrame, text_col: str, dictionary: DataFrame,
                       slot_col: str = "slot", order_col: str = "slot_order", alias_col: str = "alias",
                       out_text: str = "utterance_slots", out_count: str = "n_slots", bits: int = BITS) -> DataFrame:
    """Slot replacement by a dictionary table of any size (J2), equal to ``replace_slots``.

    A text is cut into words and single other characters; each alias is
    looked for at its rarest word only (``anchors``); verified matches are
    sorted (leftmost, then longest) and picked greedily without overlap.  The
    rows are written once, by a number of their own, and never shuffled again:
    of each slot only the places of its picks are written, and whatever reads
    the tokens of the next slot's texts makes them from the row and the picks
    before.  Slots apply in ``slot_order``; two numbers per slot and a table
    of ``bits`` bits reach the driver.
    """
    spark = df.sparkSession
    slots = (dictionary.select(slot_col, order_col).distinct().orderBy(order_col, slot_col)
             .withColumn("_name", _tokens(F.col(slot_col))).collect())
    aliases = [dictionary.where((F.col(slot_col) == row[slot_col]) & (F.col(order_col) == row[order_col]) & (F.col(alias_col) != ""))
               .select(_tokens(F.col(alias_col)).alias("_a")).distinct() for row in slots]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = kept_by_key(df.withColumn("_key", F.monotonically_increasing_id()).repartition(parts, "_key"), "_key")
    low = F.lower(F.col(text_col))
    counts = _counts(rows.select(low.alias("_low")), reduce(DataFrame.union, aliases), bits) if slots else None
    done, added = [], []

    def replaced(texts: DataFrame) -> DataFrame:
        """The tokens by now, and how many picks they have.  Only texts go through the joins: tokens take several times that."""
        for i, (picks, _) in enumerate(done):
            texts = texts.join(picks.toDF("_key", f"_at{i}", f"_len{i}"), "_key", "left")
        texts = texts.withColumn("_t", _tokens(low)).withColumn("_count", F.lit(0))
        for i, (_, name) in enumerate(done):
            at, size = F.col(f"_at{i}"), F.col(f"_len{i}")
            texts = texts.withColumn("_t", _replaced(F.col("_t"), at, size, name)).withColumn(
                "_count", F.col("_count") + F.coalesce(F.size(at), F.lit(0))).drop(at, size)
        return texts

    for row, alias in zip(slots, aliases, strict=True):
        # at least as often as in the texts by now: what is replaced still counts, and names come in
        more = spark.createDataFrame(added, "token string, n long")
        known = counts.unionByName(more).groupBy("token").agg(F.sum("n").alias("n"))
        matches = alias_matches(replaced(rows.select("_key", text_col)), alias, bits, known)
        picks = kept_by_key(_picks(matches), "_key")
        total = picks.agg(F.sum(F.size("_at"))).first()[0] or 0
        name = row["_name"] or []
        done.append((picks, name))
        added += [(token, total) for token in name]
    return replaced(rows).withColumn(out_text, F.array_join("_t", "")).withColumn(
        out_count, F.when(F.col("_t").isNotNull(), F.col("_count")).cast("int")).drop("_key", "_t", "_count")
