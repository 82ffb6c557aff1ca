"""Request handling as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T


def with_request_defaults(df: DataFrame) -> DataFrame:
    """Missing request parameters get the reference defaults.

    text -> ``Dummy``, type -> ``text``, prevTask -> ``na``, domainBias -> ``""``;
    ``domain`` stays null (= score both domains).
    """
    defaults = {"text": T.DEFAULT_TEXT, "type": T.DEFAULT_TYPE,
                "prevTask": T.DEFAULT_PREV_TASK, "domainBias": T.DEFAULT_BIAS}
    out = df
    for c, v in defaults.items():
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
        else:
            out = out.withColumn(c, F.lit(v))
    if "domain" not in df.columns:
        out = out.withColumn("domain", F.lit(None).cast("string"))
    return out
