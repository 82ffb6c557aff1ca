"""Dialogue context over a stream of turns: previous task (W2) and running domain prior.

Turns arrive in any order, over any number of micro-batches, some more than
once.  State is kept per (conversation, block of turns): the block's turns
with task and domain, so a conversation of any length is spread over keys of
bounded state.  A micro-batch that brings new turns to a block emits, from the
first new turn on, each turn's task before it and counts within the block;
what was emitted for these turns before is thereby replaced (update mode).
The sink keeps one folder per batch, overwritten if the batch is replayed.

``context`` reads the sink: the newest row of each turn, plus what the blocks
before its own add, from a table of one row per block.  The result is that of
the batch operators on the distinct turns, however these were split.

Cases: a turn that comes again is the same turn; if it comes with another task
or domain the lesser counts (null first), whatever the order of arrival; rows
without conversation or turn number are not turns; a turn without or with an
unknown domain has the neutral prior and is not counted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.operators.context import DOMAINS, NEUTRAL_PRIOR

BLOCK = 1000  # turns whose state is one key
STATE = "turns array<long>, tasks array<string>, domains array<string>"
ROW = "conv_id long, block long, turn long, task string, before string, first boolean, domain string, counts array<long>"


def _rank(value: tuple) -> list:
    return [(x is not None, x or "") for x in value]


def _update(domains: Sequence[str]):
    place = {d: i for i, d in enumerate(domains)}

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, tasks, names = state.get if state.exists else ([], [], [])
        held = dict(zip(turns, zip(tasks, names, strict=True), strict=True))
        changed = []
        for frame in frames:
            for turn, task, domain in zip(frame["turn"].tolist(), frame["task"].tolist(), frame["domain"].tolist(),
                                          strict=True):
                new = tuple(x if isinstance(x, str) else None for x in (task, domain))
                if turn not in held or _rank(new) < _rank(held[turn]):
                    held[turn] = new
                    changed.append(turn)
        if not changed:
            return
        order = sorted(held)
        state.update((order, [held[t][0] for t in order], [held[t][1] for t in order]))
        counts, out, begin = [0] * len(domains), [], min(changed)
        for i, t in enumerate(order):
            task, domain = held[t]
            if domain in place:
                counts[place[domain]] += 1
            if t >= begin:
                out.append((key[0], key[1], t, task, held[order[i - 1]][0] if i else None, i == 0, domain, list(counts)))
        yield pd.DataFrame(out, columns=["conv_id", "block", "turn", "task", "before", "first", "domain", "counts"])

    return update


def context_updates(turns: DataFrame, domains: Sequence[str] = DOMAINS, block: int = BLOCK) -> DataFrame:
    """Changed rows of a stream of turns {conv_id, turn, task, domain}."""
    rows = turns.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.floor(F.col("turn") / block).cast("long").alias("block"),
        F.col("turn").cast("long").alias("turn"), "task", "domain")
    return rows.groupBy("conv_id", "block").applyInPandasWithState(
        _update(tuple(domains)), ROW, STATE, "update", GroupStateTimeout.NoTimeout)


def run_context(turns: DataFrame, folder: str, domains: Sequence[str] = DOMAINS, block: int = BLOCK) -> str:
    """Runs the stream over everything available; sink and checkpoint are in ``folder``, the same over restarts."""
    sink = f"{folder}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    query = (context_updates(turns, domains, block).writeStream.foreachBatch(write).outputMode("update")
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return sink


def context(spark: SparkSession, sink: str, domains: Sequence[str] = DOMAINS, default: str = "na") -> DataFrame:
    """{conv_id, turn, task, domain, previousTask, prior} of all turns so far."""
    schema = ROW + ", batch_id long"
    try:
        rows = spark.read.schema(schema).parquet(sink)
    except AnalysisException as e:  # no batch has been written
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    newest = (rows.groupBy("conv_id", "turn").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("conv_id", "turn")]),
                                                           "batch_id").alias("r"))
              .select("conv_id", "turn", "r.*"))
    last = newest.groupBy("conv_id", "block").agg(F.max_by(F.struct("task", "counts"), "turn").alias("last"))
    order = Window.partitionBy("conv_id").orderBy("block")  # a row per block
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = last.select(
        "conv_id", "block", F.lag(F.struct("last.task")).over(order).alias("_left"),
        F.array(*[F.coalesce(F.sum(F.col("last.counts")[i]).over(before), F.lit(0)) for i in range(len(domains))])
        .alias("_so_far"))
    j = newest.join(blocks, ["conv_id", "block"])
    counts = F.zip_with("counts", "_so_far", lambda a, b: a + b)
    known = F.col("domain").isin(list(domains))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    prior = F.when(known, F.transform(counts, lambda x: x / total)).otherwise(
        F.array(*[F.lit(NEUTRAL_PRIOR) for _ in domains]))
    task = F.when(F.col("first"), F.col("_left.task")).otherwise(F.col("before"))
    return j.select("conv_id", "turn", "task", "domain", F.coalesce(task, F.lit(default)).alias("previousTask"),
                    prior.alias("prior"))
