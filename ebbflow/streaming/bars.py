"""Bars from a stream: late revisions replace earlier ones, windows close behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import lake


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, ticker, v, vw, h, l) over tumbling or sliding windows of events (ts, ticker, value)."""
    start = F.window("ts", width, slide or width)
    return events.withWatermark("ts", late).groupBy(start.alias("w"), "ticker").agg(F.count("*").alias("v"), F.avg("value").alias("vw"), F.max("value").alias("h"), F.min("value").alias("l")).select(F.col("w.start").alias("start"), "ticker", "v", "vw", "h", "l")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(start, end, ticker, n) of runs of events with no pause of ``gap`` or more."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "ticker").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ticker", "n")


def upsert(stream: DataFrame, path: str, tf: str, checkpoint: str):
    """Append each micro-batch to the lake under the lake's next ``seq``, so that a bar seen again wins over the earlier
    one, also over batches written by other means or before a new checkpoint. A batch that is replayed is written again
    under a higher ``seq``: the same rows, which win over themselves."""

    def add(batch: DataFrame, number: int) -> None:
        lake.write(batch, path, tf)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)
