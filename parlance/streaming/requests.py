"""Request scoring as Structured Streaming jobs.

The reference answers HTTP requests one at a time, running up to two Spark
jobs per classifier per request.  Here requests are a stream of rows: each
micro-batch goes through the same stateless projections as batch scoring
(defaults, slot replacement, all models applied to the same rows, JSON in
the JVM) and is appended to a parquet sink.  Nothing is kept in state, so no
watermark is needed; sink and checkpoint are in a folder that the caller names,
so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import requests as RQ
from parlance.functions import text as T
from parlance.operators import output as OUT
from parlance.operators import scoring as SC
from parlance.operators import train as TR


def classify_requests(requests: DataFrame, models, slot_fn,
                      text_for: dict[str, str], id_cols: Sequence[str]) -> DataFrame:
    """{id..., response}: per request the scores of the requested domain's
    models (both domains when none) as JSON, or the text form when
    ``type == 'text'``.  Stateless: works on batch and streaming frames."""
    r = RQ.with_request_defaults(requests).withColumn("utterance", F.col("text"))
    r = slot_fn(r)
    st = SC.stacked_scores(r, models, text_for, pairs_col="_pairs", domain_col="domain")
    resp = F.when(F.col("type") == "text", OUT.scores_text("_pairs")).otherwise(OUT.scores_json("_pairs"))
    return st.select(*id_cols, resp.alias("response"))


def task_request_features(requests: DataFrame, models, slot_fn, text_for: dict[str, str]) -> DataFrame:
    """Requests with ``previousTask`` and ``classifierFeatures`` (intent scores and domain bias)."""
    r = RQ.with_request_defaults(requests)
    r = r.select("*", F.col("text").alias("utterance"), T.last_segment("prevTask").alias("previousTask"),
                 T.parse_bias("domainBias").alias("prior"))
    st = SC.stacked_scores(slot_fn(r), models, text_for)
    return st.withColumn("classifierFeatures", F.concat("scores", "prior"))


def task_requests_scored(requests: DataFrame, models, task_model, slot_fn,
                         text_for: dict[str, str], id_cols: Sequence[str]) -> DataFrame:
    """{id..., predictedLabel, response}: next task of each request (C3 + K4)."""
    feats = task_request_features(requests, models, slot_fn, text_for)
    out = task_model.transform(TR.task_input(feats))
    return OUT.format_task(out.select(*id_cols, "predictedLabel"))


def run_to_parquet(scored: DataFrame, folder: str) -> str:
    """Run a streaming frame over everything available, append to ``folder``/out.

    ``folder`` is the caller's and stays the same over restarts: sink and
    checkpoint live in it, so a second run answers only what is new.
    """
    sink = f"{folder}/out"
    q = (scored.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", f"{folder}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return sink


def run_batches_to_parquet(stream: DataFrame, score, folder: str) -> str:
    """Run ``score(batch_df)`` on every micro-batch (``foreachBatch``).

    For scorers that need batch-only ML stages.  Each batch overwrites its own
    ``batch_id=<n>`` folder, so a batch replayed after a failure replaces its
    output instead of duplicating it.  ``folder`` as in ``run_to_parquet``.
    """
    sink = f"{folder}/out"

    def write(batch_df: DataFrame, batch_id: int) -> None:
        score(batch_df).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink
