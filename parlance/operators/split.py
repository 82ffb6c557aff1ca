"""Deterministic train/test split (L4).

``randomSplit`` draws per partition, so the same rows split differently when
the input is partitioned differently.  A hash of the row key with the seed
decides instead: the same row always lands on the same side, on any cluster,
with no shuffle and no extra pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference: an 80/20 split with seed 11.
TRAIN_PCT = 80
SEED = 11


def split_bucket(key, seed: int = SEED) -> Column:
    """0..99 from the first 32 bits of md5('<key>:<seed>')."""
    key = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(100)).cast("int")


def hash_split(df: DataFrame, key_col: str, train_pct: int = TRAIN_PCT, seed: int = SEED,
               out_col: str = "is_train") -> DataFrame:
    return df.withColumn(out_col, split_bucket(key_col, seed) < train_pct)


def train_test(df: DataFrame, key_col: str, train_pct: int = TRAIN_PCT, seed: int = SEED):
    b = split_bucket(key_col, seed)
    return df.filter(b < train_pct), df.filter(b >= train_pct)
