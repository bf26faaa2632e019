"""Exchange sessions in Eastern time: regular bars, session ordinals and hours, as-of lookups within a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ZONE = "America/New_York"


def eastern(ts):
    """Wall-clock time in the east of the United States of a UTC timestamp."""
    return F.from_utc_timestamp(ts, ZONE)


def early_close(day):
    """Sessions that end at 13:00: the day after Thanksgiving, July 3 and December 24 when on a weekday; July 3 not on a
    Friday, when the holiday is observed then."""
    m, d, w = F.month(day), F.dayofmonth(day), F.dayofweek(day)
    thanks = (m == 11) & (w == 6) & (d >= 23) & (d <= 29)
    return thanks | (m == 7) & (d == 3) & w.between(2, 5) | (m == 12) & (d == 24) & w.between(2, 5)


def regular(ts, minutes: int):
    """Whether a bar of ``minutes`` that starts at ``ts`` lies within the regular session, on its grid."""
    e = eastern(ts)
    start = F.hour(e) * 60 + F.minute(e)
    close = F.when(early_close(e), 780).otherwise(960)
    return F.dayofweek(e).between(2, 6) & (start >= 570) & ((start - 570) % minutes == 0) & (start + minutes <= close)


def tick_bars(ticks: DataFrame, minutes: int = 30) -> DataFrame:
    """(ts, ticker, o, h, l, c, v, vw) from ticks (ts, id, ticker, value)."""
    at = F.struct("ts", "id")
    start = F.window("ts", f"{minutes} minutes").start
    return ticks.groupBy(start.alias("start"), "ticker").agg(F.min_by("value", at).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", at).alias("c"), F.count("*").cast("double").alias("v"), F.avg("value").alias("vw")).withColumnRenamed("start", "ts")


def session_hours(bars: DataFrame, first: int = 570) -> DataFrame:
    """(ticker, day, bucket, o, h, l, c, v, vw): bars put together in seven buckets from the open, the last one short."""
    e = eastern(F.col("ts"))
    minute = F.hour(e) * 60 + F.minute(e)
    rows = bars.withColumns({"day": F.to_date(e), "bucket": F.least(F.floor((minute - first) / 60), F.lit(6)).cast("int")}).where(minute >= first)
    vw = F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("vw")), F.sum("v")), F.max_by("c", "ts"))
    return rows.groupBy("ticker", "day", "bucket").agg(F.min_by("o", "ts").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "ts").alias("c"), F.sum("v").alias("v"), vw.alias("vw"))


def session_index(times: DataFrame) -> DataFrame:
    """(ts, session, slot, is_first, is_last) of a calendar of bar times."""
    rows = times.select("ts").distinct().withColumn("day", F.to_date(eastern(F.col("ts"))))
    days = rows.select("day").distinct().withColumn("session", (F.row_number().over(Window.orderBy("day")) - 1).cast("long"))  # a calendar
    w = Window.partitionBy("day").orderBy("ts")
    rows = rows.withColumns({"slot": (F.row_number().over(w) - 1).cast("long"), "is_first": F.lag("ts").over(w).isNull(), "is_last": F.lead("ts").over(w).isNull()})
    return rows.join(days, "day").select("ts", "session", "slot", "is_first", "is_last")


def session_label(bars: DataFrame, horizon: int) -> DataFrame:
    """Open-to-open return from the next bar, only where that bar and the one ``horizon`` later share a session. An open of
    0 divides as floating point does: infinite, or NaN where both are 0."""
    w = Window.partitionBy("ticker").orderBy("ts")
    same = F.lead("session", 1).over(w) == F.lead("session", 1 + horizon).over(w)
    start, end = F.lead("o", 1).over(w), F.lead("o", 1 + horizon).over(w)
    ratio = F.when(start == 0, end * F.lit(float("inf"))).otherwise(F.try_divide(end, start))
    return bars.withColumn("label", F.when(same, ratio - 1))


def slot_shock(bars: DataFrame, sessions: int = 20) -> DataFrame:
    """``shock``: volume over its median in the same slot of the previous sessions."""
    w = Window.partitionBy("ticker", "slot").orderBy("session").rangeBetween(-sessions, -1)
    return bars.withColumn("shock", F.try_divide("v", F.percentile("v", F.lit(0.5)).over(w)))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before ``at``: one sorted pass over both, no pairs."""
    l = left.withColumns({"__v": F.lit(None).cast(right.schema[value].dataType), "__right": F.lit(False)})
    r = right.select(*by, at, F.col(value).alias("__v")).withColumn("__right", F.lit(True))
    w = Window.partitionBy(*by).orderBy(at, F.desc("__right")).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where(~F.col("__right")).drop("__v", "__right")
