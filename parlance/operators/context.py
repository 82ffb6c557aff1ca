"""Dialogue context: running domain prior (W1) and previous task.

No window here holds an unbounded group in one task:

* Grouped runs (per conversation, ordered by turn) are cut into blocks of
  ``block`` consecutive order-key values.  Per-block sums / last rows come
  from an aggregation (partial aggregation: a hot conversation costs one
  row per block per map task), block offsets are a window over that small
  block table, and the row-level window runs per (conversation, block).  A
  conversation holding a third of all rows is spread over many tasks.
* The ungrouped run (the reference walks the whole file with two driver
  counters) never uses ``Window.orderBy`` without a key.  Ordered by
  (group key, order key): run per group as above, plus each group's offset,
  an exclusive prefix sum over the one-row-per-group totals.  That prefix is
  computed over order-key ranges (boundaries from ``approxQuantile``, a
  bounded list): per-range sums (one row per range) are prefix-summed and
  broadcast, each range adds its offset to its in-range running sum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reference: two domains, in this order, neutral prior 0.5.
DOMAINS = ("nba", "weather")
NEUTRAL_PRIOR = 0.5
# Order-key span of one window block (turns per block).
BLOCK = 100_000


def _on(left: DataFrame, right: DataFrame, cols: Sequence[str]):
    """Null-safe equi-join condition on same-named columns."""
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(right[c])
        cond = e if cond is None else cond & e
    return cond


def _join_back(df: DataFrame, small: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Left join on ``cols`` (null-safe), keeping one copy of the key columns."""
    r = small.select(*[F.col(c).alias(f"_k_{c}") for c in cols],
                     *[c for c in small.columns if c not in cols])
    cond = None
    for c in cols:
        e = df[c].eqNullSafe(r[f"_k_{c}"])
        cond = e if cond is None else cond & e
    return df.join(r, cond, "left").drop(*[f"_k_{c}" for c in cols])


def _with_blocks(df: DataFrame, order_cols: Sequence[str], values: Mapping[str, Column], block: int) -> DataFrame:
    b = df.withColumn("_blk", F.floor(F.col(order_cols[0]) / F.lit(block)).cast("long"))
    for n, c in values.items():
        b = b.withColumn(f"_v_{n}", c)
    return b


def block_sums(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], values: Mapping[str, Column],
               block: int) -> DataFrame:
    """Sums ``_s_<name>`` per group and block of ``block`` order keys."""
    b = _with_blocks(df, order_cols, values, block)
    return b.groupBy(*group_cols, "_blk").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])


def blocked_running_sums(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                         values: Mapping[str, Column], block: int = BLOCK) -> DataFrame:
    """Adds, per name in ``values``, the running sum of that value within
    ``group_cols`` in ``order_cols`` order, this row included.

    The first order column must be numeric (it defines the blocks).
    """
    b = _with_blocks(df, order_cols, values, block)
    unit = [*group_cols, "_blk"]
    per = block_sums(df, group_cols, order_cols, values, block)
    wb = Window.partitionBy(*group_cols).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select(*unit, *[F.coalesce(F.sum(f"_s_{n}").over(wb), F.lit(0)).alias(f"_o_{n}") for n in values])
    j = _join_back(b, offs, unit)
    w = (Window.partitionBy(*unit).orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for n in values:
        j = j.withColumn(n, F.sum(f"_v_{n}").over(w) + F.col(f"_o_{n}"))
    return j.drop("_blk", *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def ranged_prefix(df: DataFrame, key: str, values: Mapping[str, Column], inclusive: bool = True,
                  num_ranges: int | None = None, tie_cols: Sequence[str] = ()) -> DataFrame:
    """Running sums over the whole table in ``key`` order without a one-task window.

    ``key`` must be numeric; ties are ordered by ``tie_cols``.  Rows are cut
    into ``num_ranges`` key ranges; one row per range reaches the broadcast.
    """
    spark = df.sparkSession
    n_ranges = num_ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    qs = [i / n_ranges for i in range(1, n_ranges)]
    # an error of a quarter range keeps every range below twice its share, however many ranges there are
    cuts = sorted(set(df.approxQuantile(key, qs, 1 / (4 * n_ranges)))) if qs else []
    splits = [-float("inf")] + [float(c) for c in cuts] + [float("inf")]
    tmp_key = "_order_key_d"
    ranged = Bucketizer(splits=splits, inputCol=tmp_key, outputCol="_range").transform(
        df.withColumn(tmp_key, F.col(key).cast("double"))).drop(tmp_key)
    ranged = ranged.withColumn("_range", F.col("_range").cast("int"))
    for n, c in values.items():
        ranged = ranged.withColumn(f"_v_{n}", c)
    per_range = ranged.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    # One row per range (<= n_ranges rows): prefix-sum it, then broadcast.
    wprev = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_range", *[F.coalesce(F.sum(f"_s_{n}").over(wprev), F.lit(0)).alias(f"_o_{n}") for n in values])
    end = Window.currentRow if inclusive else -1
    w = Window.partitionBy("_range").orderBy(key, *tie_cols).rowsBetween(Window.unboundedPreceding, end)
    out = ranged.join(F.broadcast(offsets), "_range")
    for n in values:
        out = out.withColumn(n, F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0)) + F.col(f"_o_{n}"))
    return out.drop("_range", *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def previous_task(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str],
                  task_col: str, default: str = "na", out_col: str = "previousTask",
                  block: int = BLOCK) -> DataFrame:
    """Task of the previous turn in the same conversation, ``default`` first.

    The first row of a block takes the last task of the group's previous
    non-empty block (from a one-row-per-block aggregate).
    """
    key = order_cols[0]
    b = df.withColumn("_blk", F.floor(F.col(key) / F.lit(block)).cast("long"))
    unit = [*partition_cols, "_blk"]
    ordkey = F.struct(*[F.col(c) for c in order_cols])
    last = b.groupBy(*unit).agg(F.max_by(F.struct(F.col(task_col).alias("t")), ordkey).alias("_last"))
    wb = Window.partitionBy(*partition_cols).orderBy("_blk")
    prev_blk = last.select(*unit, F.lag("_last").over(wb).alias("_prev_last"))
    j = _join_back(b, prev_blk, unit)
    w = Window.partitionBy(*unit).orderBy(*order_cols)
    lp = F.lag(F.struct(F.col(task_col).alias("t"))).over(w)
    prev = F.when(lp.isNotNull(), lp["t"]).otherwise(F.col("_prev_last")["t"])
    return j.withColumn(out_col, F.coalesce(prev, F.lit(default))).drop("_blk", "_prev_last")


def _prior_from_counts(domain_col: str, domains: Sequence[str], counts: Sequence, total) -> Column:
    known = F.col(domain_col).isin(list(domains))
    ratios = F.array(*[(c / total).cast("double") for c in counts])
    neutral = F.array(*[F.lit(NEUTRAL_PRIOR) for _ in domains])
    return F.when(known, ratios).otherwise(neutral)


def domain_prior(df: DataFrame, order_cols: Sequence[str], domain_col: str = "domain",
                 domains: Sequence[str] = DOMAINS, partition_cols: Sequence[str] | None = None,
                 out_col: str = "prior", num_ranges: int | None = None, block: int = BLOCK) -> DataFrame:
    """Running share of each domain among the rows so far, this row included.

    A row whose domain is missing or unknown is not counted and gets
    ``[0.5, 0.5]``.  With ``partition_cols`` the run restarts per group;
    without, it runs over the whole table in ``order_cols`` order (numeric
    order columns; with two or more, the first is the group key of the file,
    e.g. conversation, and the second the order inside it).
    """
    names = [f"_n{i}" for i in range(len(domains))] + ["_nk"]
    vals = {n: F.when(F.col(domain_col) == d, 1).otherwise(0) for n, d in zip(names, domains)}
    vals["_nk"] = F.when(F.col(domain_col).isin(list(domains)), 1).otherwise(0)

    if partition_cols:
        out = blocked_running_sums(df, partition_cols, order_cols, vals, block)
    elif len(order_cols) >= 2:
        g = order_cols[0]
        within = blocked_running_sums(df, [g], order_cols[1:], vals, block)
        # the same per-block sums as the running sums within groups, so their exchange is reused
        blocks = block_sums(df, [g], order_cols[1:], vals, block)
        totals = blocks.groupBy(g).agg(*[F.sum(f"_s_{n}").alias(f"_t{n}") for n in vals])
        offs = ranged_prefix(totals, g, {f"_g{n}": F.col(f"_t{n}") for n in vals}, inclusive=False,
                             num_ranges=num_ranges).select(g, *[f"_g{n}" for n in vals])
        out = _join_back(within, offs, [g])
        for n in vals:
            out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"_g{n}"), F.lit(0))).drop(f"_g{n}")
    else:
        out = ranged_prefix(df, order_cols[0], vals, inclusive=True, num_ranges=num_ranges)
    counts = [F.col(n) for n in names[:-1]]
    out = out.withColumn(out_col, _prior_from_counts(domain_col, domains, counts, F.col("_nk")))
    return out.drop(*names)
