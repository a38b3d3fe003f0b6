"""Monitoring of a stream of scores: an extension of batch tracking, one snapshot for each period of each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.monitoring import Monitor


def windowed_counts(df: DataFrame, time: str, width: str, target: str, late: str = "1 day") -> DataFrame:
    """window, n, bad over tumbling windows; on a stream, rows later than `late` are left out and windows close by the watermark."""
    own = df.withWatermark(time, late) if df.isStreaming else df
    return own.groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.sum(target).alias("bad"))


def track_stream(stream: DataFrame, monitor: Monitor, score: str, target: str | None, period: str, checkpoint: str) -> StreamingQuery:
    """Tracks what is there, micro-batch by micro-batch; a batch that is replayed after a failure is tracked once."""
    done: set[int] = set()

    def track(batch: DataFrame, number: int) -> None:
        if number in done:
            return
        held = batch.persist()
        try:
            for (p,) in held.select(period).distinct().orderBy(period).collect():
                monitor.track(held.where(F.col(period).eqNullSafe(F.lit(p))), str(p), score, target)
        finally:
            held.unpersist()
        done.add(number)

    return stream.writeStream.foreachBatch(track).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
