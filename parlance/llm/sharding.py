"""Balanced label propagation (DataFrame functions only).

Documents are linked through hubs: all rows with the same hub value are
neighbours (here a hub is an equal text).  A hub stands for the edges between
its rows, so no edge list of a group's pairs is ever made.  Labels are shards.
Every row starts in a shard hashed from its id; in each round the rows of a
hub learn from one join how many of their neighbours are in each shard and ask
to move to the shard that has most (a hub too large to move as a whole asks
for as many shards as have room for it).  From the number of requests between each pair of
shards the flows are found that leave no shard above its quota, rows that leave
making room for rows that come.  A flow grants requests large hubs first, so
that hubs move as a whole; a request that no longer fits is granted for the
share that does.  Rows without neighbours make room.

At the end row counts are made equal exactly (law ``rows``): rows are numbered
within their shard, linked rows first, and those beyond the quota fill the
shards below theirs.  Numbers are found by blocks: counts per (shard, block,
part), a running sum over them, and a row number within one; hubs larger than
a block are dealt over parts, so no shard's rows meet in one task.

What reaches the driver is one number per pair of shards.  Hot hubs (more than a
thousandth of all rows, so less than a thousand of them) are joined by
broadcast, all others by shuffle.

Cases: columns other than id and text are not read, whatever their names; a null
text counts as empty, so null and empty texts are linked; null ids hash like
any value; repeated rows are rows of their own with a slot each;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import hash_unit, join_by_key, stored

CLASSES = 16  # parts into which requests of hubs of like size are cut, so that quotas are used up finely


def documents_as_nodes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, hub: the compact table that everything else works on."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), F.sha2(t, 256).alias("hub"))


def _quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _counts(df: DataFrame, shards: int, column: str = "shard") -> list[int]:
    got = {r[column]: r["n"] for r in df.groupBy(column).agg(F.count("*").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def _at(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def balanced_flows(asked: list[list[float]], room: list[int]) -> list[list[float]]:
    """Flows of at most the asked ones with (in - out) of each shard within its room.

    Starts from all requests and scales the inflow of every shard that would
    overflow, until none does; what leaves a shard counts as room.
    """
    shards = range(len(room))
    flow = [row[:] for row in asked]
    for _ in range(200):
        factor = []
        for t in shards:
            come = sum(flow[s][t] for s in shards)
            factor.append(min(1.0, (room[t] + sum(flow[t])) / come) if come else 1.0)
        if min(factor) > 1 - 1e-6:
            break
        flow = [[flow[s][t] * factor[t] for t in shards] for s in shards]
    return flow


def propagate(linked: DataFrame, sizes: DataFrame, total: int, shards: int, rounds: int, seed: int) -> DataFrame:
    """``linked`` (doc_id, size, text_crc32, hub, part, shard) with shards moved towards the neighbours'.

    ``sizes`` has rows per hub.  The state is written to the shared folder
    after each round; rounds end early when nobody moves.
    """
    quotas = _quotas(total, shards)
    heavy = max(1, total // 1000)
    for turn in range(rounds):
        loads = _counts(linked, shards)
        room = [max(q - n, 0) for q, n in zip(quotas, loads, strict=True)]
        # homes of a hub: its shards by falling count (ties: those with room first, then by a hash of hub, shard and
        # round, the same for all its rows, so that a hub whose home stays full asks for another one next time),
        # one if the hub can move as a whole, else as many as have room for it
        per = linked.groupBy("hub", "shard").agg(F.count("*").alias("n")).join(sizes, "hub")
        falling = Window.partitionBy("hub").orderBy(
            F.desc("n"), (_at(room, F.col("shard")) == 0), F.xxhash64("hub", "shard", F.lit(seed + turn)))
        before = F.sum(F.col("n") + _at(room, F.col("shard"))).over(falling.rowsBetween(Window.unboundedPreceding, -1))
        per = per.withColumn("place", F.row_number().over(falling)).withColumn("before", F.coalesce(before, F.lit(0)))
        splits = F.col("rows") > max(quotas[0] // 4, 1)
        homes = per.where((F.col("place") == 1) | (splits & (F.col("before") < F.col("rows"))))
        profile = homes.groupBy("hub").agg(
            F.first("rows").alias("rows"), F.array_sort(F.collect_list("shard")).alias("homes"))  # a row per hub
        asked = join_by_key(linked, profile, "hub", heavy, "rows")
        homes = F.col("homes")
        pick = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(seed + turn)), F.size(homes)).cast("int")
        asked = asked.withColumn("to", F.when(~F.array_contains(homes, F.col("shard")), F.get(homes, pick)))
        # priority: larger hubs first, hubs of like size in parts
        asked = asked.withColumn("class", -F.floor(F.log2("rows")) * CLASSES
                                 + F.pmod(F.xxhash64("hub", F.lit(seed + turn)), F.lit(CLASSES)))
        asked = stored(asked.drop("homes"), "asked")
        wish = stored(asked.where(F.col("to").isNotNull()).groupBy("shard", "to", "class")
                      .agg(F.count("*").alias("n")), "wishes")
        flows = [[0.0] * shards for _ in range(shards)]
        for r in wish.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():  # a number per pair of shards
            flows[r["shard"]][r["to"]] = float(r["n"])
        flows = balanced_flows(flows, room)
        before = F.sum("n").over(Window.partitionBy("shard", "to").orderBy("class")
                                 .rowsBetween(Window.unboundedPreceding, -1))
        most = _at([f for row in flows for f in row], F.col("shard") * shards + F.col("to"))
        grant = wish.select("shard", "to", "class", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (
            most - F.coalesce(before, F.lit(0))) / F.col("n"))).alias("share"))
        granted = asked.join(F.broadcast(grant), ["shard", "to", "class"], "left")  # pairs of shards x classes
        draw = hash_unit(F.col("doc_id"), F.col("text_crc32"), F.lit(seed + turn), F.lit("draw"))
        moves = F.coalesce(draw < F.col("share"), F.lit(False))
        linked = stored(granted.select("doc_id", "size", "text_crc32", "hub", "part",
                                       F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard"),
                                       moves.alias("moved")), "labels")
        moved = linked.where("moved").limit(1).count()
        linked = linked.drop("moved")
        if not moved:
            break
    return linked


def equalise(labelled: DataFrame, total: int, shards: int, block_rows: int) -> DataFrame:
    """Final shard and slot: counts at most one apart, linked rows moved last."""
    quotas = _quotas(total, shards)
    counts = _counts(labelled, shards)
    surplus = [max(n - q, 0) for n, q in zip(counts, quotas, strict=True)]
    surplus_before = [sum(surplus[:s]) for s in range(shards)]
    blocks = max(1, total // shards // block_rows)
    order = ["alone", "block", "part"]
    df = labelled.withColumn("block", F.when(F.col("alone"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)))
                             .otherwise(F.pmod(F.xxhash64("hub"), F.lit(blocks))).cast("int"))
    per = df.groupBy("shard", *order).agg(F.count("*").alias("n"))
    running = Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("shard", *order, F.coalesce(F.sum("n").over(running), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", *order).orderBy("hub", "doc_id", "text_crc32", "size")
    df = df.withColumn("row", F.row_number().over(inside) - 1).join(starts, ["shard", *order])
    at = F.col("start") + F.col("row")
    extra = at - _at(quotas, F.col("shard")) + _at(surplus_before, F.col("shard"))
    shard, slot, begun = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        free = max(quotas[s] - counts[s], 0)
        here = (extra >= begun) & (extra < begun + free)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, extra - begun + counts[s]).otherwise(slot)
        begun += free
    stays = at < _at(quotas, F.col("shard"))
    return df.withColumns({"slot": F.when(stays, at).otherwise(slot).cast("long"),
                           "shard": F.when(stays, F.col("shard")).otherwise(shard).cast("int")})


def balanced_shards(nodes: DataFrame, shards: int = 16, rounds: int = 6, seed: int = 7,
                    block_rows: int = 2000) -> DataFrame:
    """Adds shard and slot to ``nodes`` (doc_id, size, text_crc32, hub)."""
    nodes = stored(nodes, "nodes")
    total = nodes.count()
    start = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(seed)), F.lit(shards)).cast("int")
    sizes = stored(nodes.groupBy("hub").agg(F.count("*").alias("rows")).where("rows > 1"), "hubs")
    heavy = max(1, total // 1000)
    # rows of a large hub have a second block number, so that no block holds more of them than a few block_rows
    part = F.when(F.col("rows") > block_rows, F.pmod(F.xxhash64(
        F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id())),
        F.ceil(F.col("rows") / block_rows))).otherwise(0)
    with_hub = (join_by_key(nodes, sizes, "hub", heavy, "rows").withColumn("shard", start)
                .withColumn("part", part.cast("int")))
    with_hub = stored(with_hub, "start")
    linked = propagate(with_hub.where("rows is not null").drop("rows"), sizes, total, shards, rounds, seed)
    alone = with_hub.where("rows is null").drop("rows")
    both = linked.withColumn("alone", F.lit(False)).unionByName(alone.withColumn("alone", F.lit(True)))
    return equalise(stored(both, "labelled"), total, shards, block_rows)
