"""Rows that arrive in a stream are scored against a static catalogue; group gates stay with batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from matchloom.operators import calibrate, candidates, route


def decisions(signals: DataFrame, catalogue: DataFrame) -> DataFrame:
    """BM25, min-max, Platt and the quadrant for signals (id, terms)."""
    from pyspark.sql import functions as F

    found = candidates.bm25(signals, catalogue)
    scored = found.withColumn("score", calibrate.platt(calibrate.min_max(F.col("score"), "id")))
    return route.quadrant(signals, scored)


def score_stream(signals: DataFrame, catalogue: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Decides every arriving signal and appends to Parquet under ``target``; a repeated batch overwrites its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        decisions(rows, catalogue).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = signals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
