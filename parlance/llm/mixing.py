"""Mixing sources to target weights.

Sizes are summed per source; a source's target is its weight's share of the
mix, but no more than a limit times its own size, and what a limited source
leaves over is shared again by weight until no source is above its limit.
The repetition rate of a source is target / size, and each of its documents is
taken floor(rate) times plus once more if a number hashed from its id, its text
and the seed is below the fraction.

Every step is an aggregation or a join on the table of sources, which is never
gathered; per round of sharing two numbers reach the driver.

Cases: a null text has size 0; null is a source of its own, ranked last; a
source of size 0 has target 0 and its documents are taken 0 times; rows that
share id and text (null ids, repeated rows) draw by their place in the input as
well, so each draws for itself; more columns, whatever their names, are kept by
``mixed_documents`` and not read otherwise; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import hash_unit, n_words, quoted, stored

FEW = 10_000  # rows of a table that may be broadcast


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
                   limit: float = 2.0) -> DataFrame:
    """Per source: source_size, weight, target, rate.  ``sizes`` has source and size per document.

    Sources take the weights in turn, in code point order, null last.  The
    rank is the place in a range-partitioned sort: per partition its number of
    sources, then a running sum over the partitions.
    """
    spark = sizes.sparkSession
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = (sums.repartitionByRange(F.col("source").asc_nulls_last())
               .sortWithinPartitions(F.col("source").asc_nulls_last()))
    placed = stored(ordered.select("*", F.monotonically_increasing_id().alias("_place")), "sources")
    part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("p")).count().orderBy("p").collect()  # a row per partition
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["p"], before))
        before += r["count"]
    starts = spark.createDataFrame(offsets, "_part long, _before long")
    ranked = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    table = ranked.select("source", "source_size", F.get(cycle, ((F.col("_before") + row) % len(weights)).cast("int"))
                          .alias("weight"))
    total = table.agg(F.sum("source_size")).first()[0] or 0

    level = 0.0  # target per unit of weight of the sources below their limit
    most = F.lit(float(limit)) * F.col("source_size")
    while total:
        free = F.col("weight") * level < most
        left, over = table.agg(F.sum(F.when(free, F.lit(0.0)).otherwise(most)),
                               F.sum(F.when(free, F.col("weight")))).first()
        if not over:
            break
        new = (share * total - left) / over
        if new <= level:
            break
        level = new
    target = F.least(F.col("weight") * F.lit(level), most)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return table.select("source", "source_size", "weight", target.alias("target"), rate.alias("rate"))


def copies(rate: Column, draw: Column) -> Column:
    """floor(rate) plus one if the draw (in [0, 1)) is below the fraction."""
    whole = F.floor(rate)
    return (whole + (draw < rate - whole).cast("long")).cast("long")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size, text_hash and place (of the row in the input)."""
    t = F.col(text)
    return docs.select("doc_id", "source", n_words(t).alias("size"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("text_hash"),
                       F.monotonically_increasing_id().alias("place"))


def few(table: DataFrame, limit: int = FEW) -> bool:
    """Whether the table has at most ``limit`` rows, so that it may be broadcast."""
    return table.limit(limit + 1).count() <= limit


def with_copies(docs: DataFrame, small: DataFrame, seed: int = 0, salt_rows: int = 100_000, **mix) -> DataFrame:
    """``docs`` (source, doc_id, text_hash, place and any more) plus source_size, target, rate, copies.

    ``small`` (doc_id, source, size, text_hash), a written table, has the same
    rows without more columns; all counts come from it.  The draw is hashed
    from id and text; only where several rows share both their place tells
    them apart, so that each draws for itself.  The tables of sources and of
    shared ids are joined by broadcast where they are counted to be small, so
    ``docs`` are not shuffled; larger ones are joined on (source, salt) with a
    salt for every ``salt_rows`` rows of a source, and on (id, text hash, salt).
    """
    targets = stored(source_targets(small.select("source", "size"), **mix), "targets")
    targets = targets.withColumnRenamed("source", "_source")
    shared = stored(small.groupBy("doc_id", "text_hash").agg(F.count("*").alias("_n")).where("_n > 1")
                    .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_n"), "shared")
    same_id = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    own = F.xxhash64("place", F.lit("salt"))
    if few(shared):
        marked = docs.join(F.broadcast(shared), same_id, "left")
    else:  # every copy of a pair has a salt of its own, and rows are dealt over the most there are
        most = shared.agg(F.max("_n")).first()[0] // salt_rows + 1
        salts = F.sequence(F.lit(0), F.lit(most - 1))
        marked = docs.withColumn("_salt", F.pmod(own, F.lit(most))).join(
            shared.withColumn("_salt2", F.explode(salts)), same_id & (F.col("_salt") == F.col("_salt2")), "left")
    draw = hash_unit(F.col("doc_id"), F.col("text_hash"), F.when(F.col("_n").isNotNull(), F.col("place")), F.lit(seed))
    marked = marked.withColumn("_draw", draw).drop("_id", "_hash", "_n", "_salt", "_salt2")
    same_source = F.col("source").eqNullSafe(F.col("_source"))
    if few(targets):
        joined = marked.join(F.broadcast(targets), same_source)
    else:
        rows = small.groupBy(F.col("source").alias("_of")).agg(F.count("*").alias("_n"))
        spread = targets.join(rows, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
        most = spread.agg(F.max("_n")).first()[0] // salt_rows + 1
        spread = spread.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).drop("_n")
        joined = marked.withColumn("_salt", F.pmod(own, F.lit(most))).join(
            spread, same_source & (F.col("_salt") == F.col("_salt2"))).drop("_salt", "_salt2")
    return joined.drop("_source").withColumn("copies", copies(F.col("rate"), F.col("_draw"))).drop("_draw")


def mixed_documents(docs: DataFrame, seed: int = 0, **mix) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns only.

    Ids, sources and sizes are written first; then texts are read once more
    and, with few sources, not shuffled.
    """
    small = stored(sized(docs).drop("place"), "sizes")
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_doc")
    rows = docs.select(row, "doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
                       F.monotonically_increasing_id().alias("place"))
    taken = with_copies(rows, small, seed, **mix).where(F.col("copies") > 0)
    return (taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("_doc.*"))
