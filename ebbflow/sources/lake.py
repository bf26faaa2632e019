"""The bar lake: partitioned Parquet, upserts by sequence number, a coverage catalogue, compaction and retention."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("t", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("o", "h", "l", "c", "v", "vw")], T.StructField("seq", T.LongType())])


def latest(rows: DataFrame, keys: tuple[str, ...] = ("ticker", "t")) -> DataFrame:
    """One row for each key: that of the highest ``seq``. A grouped maximum, so copies meet before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), "seq").alias("x")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def first_times(rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    rows = rows if wanted is None else rows.join(wanted, "ticker", "left_semi")
    return rows.groupBy("ticker").agg(F.min("t").alias("first_t"))


def merge_coverage(*catalogues: DataFrame) -> DataFrame:
    """covered_from only moves earlier, complete only later."""
    every = catalogues[0]
    for c in catalogues[1:]:
        every = every.unionByName(c)
    return every.groupBy("ticker").agg(F.min("covered_from").alias("covered_from"), F.max("complete").alias("complete"))


def parted(rows: DataFrame) -> DataFrame:
    at = F.timestamp_seconds("t")
    return rows.withColumns({"year": F.year(at), "month": F.month(at)})


def next_seq(spark: SparkSession, path: str) -> int:
    """One more than the largest ``seq`` in the lake: 1 for a new one."""
    if not _exists(spark, path):
        return 1
    return (spark.read.parquet(path).agg(F.max("seq")).first()[0] or 0) + 1


def write(rows: DataFrame, path: str, tf: str, seq: int | None = None) -> int:
    """Append one batch under one ``seq`` (the lake's next, if none is given) and return it; the last row of a key within
    the batch (by ``place``, if there) wins."""
    seq = next_seq(rows.sparkSession, path) if seq is None else seq
    if "place" in rows.columns:
        rows = latest(rows.withColumnRenamed("place", "seq")).drop("seq")
    rows = parted(rows.withColumns({"tf": F.lit(tf), "seq": F.lit(seq).cast("long")}))
    rows.write.mode("append").partitionBy("tf", "year", "month").parquet(path)
    return seq


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def part_files(spark: SparkSession, path: str, tf: str) -> dict[str, list[str]]:
    """The Parquet files of ``tf`` by the folder of their month."""
    fs, where = _fs(spark, f"{path}/tf={tf}")
    out: dict[str, list[str]] = {}
    if fs.exists(where):
        found = fs.listFiles(where, True)
        while found.hasNext():
            name = str(found.next().getPath())
            if name.endswith(".parquet"):
                out.setdefault(name.rsplit("/", 1)[0], []).append(name)
    return out


def file_count(spark: SparkSession, path: str, tf: str) -> int:
    return sum(map(len, part_files(spark, path, tf).values()))


def quarantine(spark: SparkSession, path: str, tf: str, to: str) -> list[str]:
    """Move every file of ``tf`` that cannot be decoded in all columns to the folder ``to`` and return their names; the
    coverage of ``tf`` is then to be cleared. Files are tried together, and one by one only where that fails."""

    def broken(names: list[str]) -> list[str]:
        try:
            spark.read.schema(SCHEMA).parquet(*names).agg(*[F.count(c) for c in SCHEMA.names], F.sum(F.xxhash64(*SCHEMA.names) % 7)).collect()
            return []
        except Exception:  # noqa: BLE001  whatever a reader says about a file it cannot read
            if len(names) == 1:
                return names
            half = len(names) // 2
            return broken(names[:half]) + broken(names[half:])

    names = sorted(n for own in part_files(spark, path, tf).values() for n in own)
    bad = broken(names) if names else []
    for n in bad:
        fs, where = _fs(spark, n)
        _, target = _fs(spark, f"{to}/{n.split(path.rstrip('/').split(':')[-1], 1)[-1].strip('/')}")
        fs.mkdirs(target.getParent())
        fs.rename(where, target)
    return bad


def clear_coverage(catalogue: DataFrame, tf: str) -> DataFrame:
    return catalogue.where(F.col("tf") != tf)


def coverage(catalogue: DataFrame, tf: str, wanted: DataFrame) -> DataFrame:
    """Rows of the catalogue (ticker, tf, covered_from, complete) for the wanted names."""
    return catalogue.where(F.col("tf") == tf).join(wanted.select("ticker").distinct(), "ticker", "left_semi")


def complete_through(bars: DataFrame, tf_seconds: int, fetched: int) -> DataFrame:
    """(ticker, complete): the last bar of each ticker that had ended when it was fetched."""
    return bars.where(F.col("t") + tf_seconds <= fetched).groupBy("ticker").agg(F.max("t").alias("complete"))


def read(spark: SparkSession, path: str, tf: str, start: int, end: int, wanted: DataFrame | None = None) -> DataFrame:
    """Rows of ``tf`` with start <= t < end, pruned by year and month, newest ``seq`` of each (ticker, t)."""
    rows = spark.read.parquet(path).where(F.col("tf") == tf)
    a, b = F.timestamp_seconds(F.lit(start)), F.timestamp_seconds(F.lit(max(start, end - 1)))
    month = F.col("year") * 12 + F.col("month")
    rows = rows.where(F.col("year").between(F.year(a), F.year(b)) & (month >= F.year(a) * 12 + F.month(a)) & (month <= F.year(b) * 12 + F.month(b)))
    rows = rows.where((F.col("t") >= start) & (F.col("t") < end))
    if wanted is not None:
        rows = rows.join(wanted.select("ticker").distinct(), "ticker", "left_semi")
    return latest(rows.drop("tf", "year", "month"))


def compact(spark: SparkSession, path: str, tf: str, max_files: int = 1) -> int:
    """Rewrite each month of ``tf`` that has more than ``max_files`` files as one sorted file with a row a key; returns how
    many. A month's new file is there, beside the old ones, before these go: a reader in between sees rows twice, of
    which the same wins."""
    done = 0
    for folder, names in part_files(spark, path, tf).items():
        if len(names) <= max_files:
            continue
        rows = latest(spark.read.schema(SCHEMA).parquet(*names))
        rows.repartition(1).sortWithinPartitions("ticker", "t").write.mode("append").parquet(folder)  # one month of one timeframe
        for n in names:
            fs, where = _fs(spark, n)
            fs.delete(where, False)
        done += 1
    return done


def policy(text: str | None) -> dict[str, int | None]:
    """Days to keep by timeframe, from JSON; without a file 730 days of hours. Raises for what is no positive number."""
    if text is None:
        return {"1h": 730, "1d": None, "1w": None}
    given = json.loads(text)
    if not isinstance(given, dict):
        raise ValueError("a retention policy is a JSON object")
    out = {tf: given.get(tf) for tf in ("1h", "1d", "1w")}
    for tf, days in out.items():
        if days is not None and (not isinstance(days, int) or isinstance(days, bool) or days <= 0):
            raise ValueError(f"retention for {tf} must be a positive integer or null")
    return out


def retain(spark: SparkSession, path: str, keep: dict[str, int | None], now: int) -> int:
    """Delete the months that a policy drops and return how many."""
    gone = 0
    for tf, days in keep.items():
        if days is None or not _exists(spark, f"{path}/tf={tf}"):
            continue
        for r in retained(spark, path, tf, now - days * 86_400).collect():  # months
            fs, where = _fs(spark, f"{path}/tf={tf}/year={r.year}/month={r.month}")
            gone += fs.delete(where, True)
    return gone


def retained(spark: SparkSession, path: str, tf: str, cutoff: int) -> DataFrame:
    """Partitions (year, month) of ``tf`` that a retention policy drops: whole months that end at or before ``cutoff``."""
    months = spark.read.parquet(path).where(F.col("tf") == tf).select("year", "month").distinct()
    end = F.unix_timestamp(F.add_months(F.make_date("year", "month", F.lit(1)), 1).cast("timestamp"))
    return months.where(end <= cutoff)


def bars_page(pages: DataFrame, column: str = "value") -> DataFrame:
    """Rows of vendor pages: JSON {bars: {symbol: [{t, o, h, l, c, v, vw}]}, next_page_token}; a missing vw is 0."""
    bar = "array<struct<t:timestamp,o:double,h:double,l:double,c:double,v:double,vw:double>>"
    page = pages.select(F.from_json(column, f"bars map<string,{bar}>, next_page_token string").alias("p"))
    rows = page.select(F.explode("p.bars").alias("ticker", "own")).select("ticker", F.explode("own").alias("b"))
    return rows.select("ticker", F.unix_timestamp("b.t").alias("t"), "b.o", "b.h", "b.l", "b.c", "b.v", F.coalesce("b.vw", F.lit(0.0)).alias("vw"))


def tickers(rows: DataFrame) -> DataFrame:
    return rows.select("ticker").distinct()


def with_pending(rows: DataFrame, pending: DataFrame) -> DataFrame:
    """The lake's rows with those that wait to be written, which carry a higher ``seq`` and win."""
    return latest(rows.unionByName(pending))
