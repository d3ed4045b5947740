"""Screening of profiles as they arrive: each micro-batch's best is merged into the stored best.

The stored table holds k rows per query, so a merge costs the same however long the stream has run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shapelake.operators.screening import merge_top_k, screen


def screen_stream(arrivals: DataFrame, panel: DataFrame, state: str, checkpoint: str, mode: str = "vol", k: int = 100, **options) -> StreamingQuery:
    """Start a query that keeps (query_id, rank, score, id) under ``state``/v<n>; an epoch that runs again overwrites its own."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = screen(panel, batch, mode, k, **options)
        parts = [now] if epoch == 0 else [now, spark.read.parquet(f"{state}/v{epoch - 1}")]
        merge_top_k(parts, k).write.mode("overwrite").parquet(f"{state}/v{epoch}")

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, state: str, query: StreamingQuery) -> DataFrame:
    """The best after the last finished epoch."""
    return spark.read.parquet(f"{state}/v{query.lastProgress['batchId']}")
