"""Files of the model as DataFrames: CSV caches, universes, portfolios, vendor answers, filing archives, external scores."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import TIMEFRAMES, fnv1a, number, quarter_of, value_to_usd

#: Headers of the files.
BAR_HEADER = ("t", "o", "h", "l", "c", "v", "vw")
EXTERNAL_HEADER = "t,ticker,score"


def files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the files in a folder, by the file system that Spark reads; none where there is no folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(f.getPath()) for f in fs.listStatus(where) if f.isFile()) if fs.exists(where) else []


def csv(spark: SparkSession, path, columns: list[str], header: bool = True) -> DataFrame:
    """Rows of CSV files by position: quotes doubled within quotes, either line end, empty rows left out, short rows with
    nulls. All columns are text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, header=header, enforceSchema=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE")
    return rows.where(F.greatest(*[F.col(c).isNotNull() for c in columns], F.lit(False)))


def csv_by_name(spark: SparkSession, path) -> DataFrame:
    """Rows of CSV files by the names of their header, all as text."""
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)


def bar_cache(spark: SparkSession, root: str, tf: str) -> tuple[DataFrame, DataFrame]:
    """(bars, coverage) of a cache of CSV files <root>/<tf>/<ticker>.csv with the exact bar header, and <ticker>.from files
    with the time from which a ticker is covered. Rows that are no numbers are left out, as are files of another header."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[a-z]+$", 1)
    lines = spark.read.option("pathGlobFilter", "*.csv").text(f"{root}/{tf}", wholetext=True).select(F.url_decode(stem).alias("ticker"), F.split(F.replace("value", F.lit("\r"), F.lit("")), "\n").alias("lines"))
    fine = lines.where(F.col("lines")[0] == ",".join(BAR_HEADER)).select("ticker", F.posexplode("lines").alias("n", "line")).where("n > 0 and line <> ''")
    parts = fine.select("ticker", "n", F.split("line", ",").alias("x")).where(F.size("x") >= len(BAR_HEADER))
    cols = [F.get("x", i).try_cast("long" if c == "t" else "double").alias(c) for i, c in enumerate(BAR_HEADER)]
    bars = parts.select("ticker", "n", *cols).dropna(subset=list(BAR_HEADER)).withColumn("tf", F.lit(tf)).withColumnRenamed("n", "place")
    marks = spark.read.option("pathGlobFilter", "*.from").text(f"{root}/{tf}", wholetext=True)
    coverage = marks.select(F.url_decode(stem).alias("ticker"), F.regexp_extract("value", r"^\s*(-?\d+)", 1).try_cast("long").alias("covered_from")).where("covered_from is not null")
    return bars, coverage


def constituents(spark: SparkSession, path: str) -> DataFrame:
    """(place, ticker, name, sector) in the order of the file, rows of fewer than three fields left out."""
    return csv(spark, path, ["ticker", "name", "sector"]).where("sector is not null").withColumn("place", F.monotonically_increasing_id()).select("place", "ticker", "name", "sector")


def funds(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, ["ticker", "tracks"]).where("tracks is not null")


def portfolio(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, weight) of a portfolio file; raises unless the weights sum to 1 within 1e-6."""
    p = spark.read.schema("initial_cash double, inception string, holdings array<struct<ticker:string,weight:double>>").json(path, multiLine=True)
    rows = p.select(F.explode("holdings").alias("h")).select("h.ticker", "h.weight")
    total = rows.agg(F.sum("weight")).first()[0] or 0.0
    if abs(total - 1.0) > 1e-6:
        raise ValueError(f"portfolio weights sum to {total}, expected 1")
    return rows


def ticker_list(spark: SparkSession, path: str) -> DataFrame:
    """(place, ticker): the column ``ticker`` of a CSV file that has one, else a name a line with # for remarks; each once,
    in the order of the file."""
    lines = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    first = lines.orderBy("place").first()
    head = [c.strip() for c in (first["value"] if first else "").split(",")]
    if "ticker" in head:
        rows = csv_by_name(spark, path).select(F.monotonically_increasing_id().alias("place"), F.trim("ticker").alias("ticker"))
    else:
        rows = lines.select("place", F.trim(F.replace("value", F.lit("\r"), F.lit(""))).alias("ticker")).where(~F.col("ticker").startswith("#"))
    return rows.where("ticker <> ''").groupBy("ticker").agg(F.min("place").alias("place")).select("place", "ticker")


_SNAPSHOT = re.compile(r"universe_(\d{4}-\d{2}-\d{2})(?:_n(\d+))?\.csv")


def snapshots(paths: list[str]) -> list[tuple[str, int | None, str]]:
    """(date, size or None, path) of the snapshots among ``paths``."""
    found = ((_SNAPSHOT.fullmatch(p.rsplit("/", 1)[-1]), p) for p in paths)
    return [(m[1], int(m[2]) if m[2] else None, p) for m, p in found if m]


def latest_snapshot(paths: list[str]) -> str | None:
    """The newest snapshot; of one date, the larger name."""
    known = [(d, p.rsplit("/", 1)[-1], p) for d, _, p in snapshots(paths)]
    return max(known)[2] if known else None


def find_snapshot(paths: list[str], size: int, today: date, days: int) -> str | None:
    """The newest snapshot of exactly ``size`` that is less than ``days`` old."""
    known = [(d, p) for d, n, p in snapshots(paths) if n == size and (today - date.fromisoformat(d)).days < days]
    return max(known)[1] if known else None


def write_snapshot(ranked: DataFrame, path: str) -> None:
    """One CSV file of (ticker, name, sector, exchange, median_dollar_volume) by place."""
    ranked.orderBy("place").select("ticker", "name", F.coalesce("sector", F.lit("Unclassified")).alias("sector"), "exchange", "median_dollar_volume").coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def assets(answers: DataFrame, column: str = "value") -> DataFrame:
    """(symbol, name, exchange, tradable) of vendor answers that are JSON arrays; entries without a symbol are left out."""
    kind = "array<struct<symbol:string,name:string,exchange:string,tradable:boolean>>"
    rows = answers.select(F.explode(F.from_json(column, kind)).alias("a")).where("a.symbol is not null")
    return rows.select("a.symbol", F.coalesce("a.name", F.lit("")).alias("name"), F.coalesce("a.exchange", F.lit("")).alias("exchange"), F.coalesce("a.tradable", F.lit(False)).alias("tradable"))


def company_tickers(answers: DataFrame, column: str = "value") -> DataFrame:
    """(ticker, cik) of a register {key: {ticker, cik_str}}, whose number may be text."""
    rows = answers.select(F.explode(F.from_json(column, "map<string,struct<ticker:string,cik_str:string>>")).alias("k", "e"))
    return rows.where("e.ticker is not null and e.cik_str is not null").select(F.upper("e.ticker").alias("ticker"), F.col("e.cik_str").alias("cik"))


def submissions(answers: DataFrame, column: str = "value") -> DataFrame:
    """(sic, description) of submission answers, whose code may be a number or text."""
    s = F.from_json(column, "sic string, sicDescription string")
    return answers.select(s.alias("s")).select(F.coalesce("s.sic", F.lit("")).alias("sic"), F.coalesce("s.sicDescription", F.lit("")).alias("description"))


def sector_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each ticker (ticker, cik, sic, sic_description, sector, fetched_at); a time that is none is 0: stale."""
    from ..functions.scalar import parse_rfc3339

    rows = csv(spark, path, ["ticker", "cik", "sic", "sic_description", "sector", "fetched_at"]).where("ticker is not null and fetched_at is not null").withColumn("place", F.monotonically_increasing_id())
    rows = rows.withColumn("fetched_at", F.coalesce(parse_rfc3339(F.col("fetched_at")), F.lit(0).cast("long")))
    last = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("place")))
    return rows.withColumn("k", last).where("k = 1").drop("k", "place")


def stale(cache: DataFrame, wanted: DataFrame, now: int, days: int = 90) -> DataFrame:
    """(ticker): wanted names that the cache lacks or holds from longer than ``days`` ago."""
    fresh = cache.where(F.lit(now) - F.col("fetched_at") < days * 86_400)
    return wanted.select("ticker").distinct().join(fresh, "ticker", "left_anti")


def external_scores(spark: SparkSession, name: str, path: str, panel: DataFrame) -> tuple[DataFrame, dict]:
    """Scores (bar_idx, ticker, score) of an external signal, CSV t,ticker,score, against a panel (t, bar_idx, ticker); and
    {digest, unknown_tickers}. Raises for another header, a number that is none, a time that is no bar, and a (t, ticker)
    that comes twice; unknown tickers are counted and left out; an empty or nan score is null."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]{1,64}", name) or name in BUILT_IN:
        raise ValueError(f"an external signal cannot be named {name!r}")
    text = spark.read.text(path, wholetext=True).first()  # one file, read whole for its digest
    body = text["value"] if text else ""
    if body.split("\n", 1)[0].rstrip("\r") != EXTERNAL_HEADER:
        raise ValueError(f"{name}: the header must be {EXTERNAL_HEADER!r}")
    x = F.split("line", ",", -1)
    lines = spark.read.text(path).select(F.replace("value", F.lit("\r"), F.lit("")).alias("line")).where(f"line <> '' and line <> '{EXTERNAL_HEADER}'")
    given = F.get(x, F.lit(2))
    none = given.isin("", "nan", "NaN")
    rows = lines.select(F.size(x).alias("n"), F.get(x, F.lit(0)).try_cast("long").alias("t"), F.get(x, F.lit(1)).alias("ticker"), none.alias("none"), F.when(~none, given.try_cast("double")).alias("score"))
    calendar, names = panel.select("t", "bar_idx").distinct(), panel.select("ticker", F.lit(True).alias("known")).distinct()
    rows = rows.join(F.broadcast(calendar), "t", "left").join(names, "ticker", "left")
    bad = (F.col("n") != 3) | F.col("t").isNull() | ~F.col("none") & (F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))) | F.col("bar_idx").isNull()
    known = rows.where("known")
    told = rows.agg(F.count(F.when(bad, 1)).alias("bad"), F.count(F.when(F.col("known").isNull(), 1)).alias("unknown")).first()
    twice = known.groupBy("bar_idx", "ticker").count().where("count > 1").limit(1).count()
    if told.bad or twice:
        raise ValueError(f"{name}: {told.bad} bad lines, {'a' if twice else 'no'} pair given twice")
    return known.select("bar_idx", "ticker", "score"), {"digest": fnv1a(body), "unknown_tickers": told.unknown}


#: Names that curves of the study itself have.
BUILT_IN = frozenset(("blend", "score", "pulse1", "pulse5", "pulse20", "pi_rel_size", "neg_hotness", "inflow_mom5", "forecast"))


def archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(filings, rows) of filing archives (ZIP files of tab-separated tables): filings (accession, cik, period, filed, form,
    is_amendment, amendment_type) and rows (accession, place, issuer, cusip, shares, value, kind, put_call). A table is found
    by its name in any folder, a field by its header."""

    def run(batches):
        import io
        import zipfile

        import pandas as pd

        want = {"SUBMISSION.TSV": ("ACCESSION_NUMBER", "CIK", "PERIODOFREPORT", "FILING_DATE", "SUBMISSIONTYPE"), "COVERPAGE.TSV": ("ACCESSION_NUMBER", "ISAMENDMENT", "AMENDMENTTYPE"), "INFOTABLE.TSV": ("ACCESSION_NUMBER", "NAMEOFISSUER", "CUSIP", "SSHPRNAMT", "VALUE", "SSHPRNAMTTYPE", "PUTCALL")}
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        short = name.rsplit("/", 1)[-1].upper()
                        if short not in want:
                            continue
                        with z.open(name) as f:
                            lines = io.TextIOWrapper(f, encoding="utf-8-sig", errors="replace", newline="")
                            head = next(lines, "").rstrip("\r\n").split("\t")
                            at = [head.index(c) if c in head else None for c in want[short]]
                            rows: list[tuple] = []
                            for n, line in enumerate(lines):  # a table may be long: so many rows at a time
                                x = line.rstrip("\r\n").split("\t")
                                own = [(x[i].strip() if i is not None and i < len(x) else "") for i in at]
                                rows.append((short[:-4], n, own + [""] * (7 - len(own))))
                                if len(rows) >= 20_000:
                                    yield pd.DataFrame(rows, columns=["table", "place", "x"])
                                    rows = []
                            yield pd.DataFrame(rows, columns=["table", "place", "x"])

    every = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "table string, place long, x array<string>")

    def of(table, *names):
        return every.where(F.col("table") == table).select("place", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)]).where("accession <> ''")

    subs = of("SUBMISSION", "accession", "cik", "period", "filed", "form").where("period <> '' and filed <> ''").drop("place")
    cover = of("COVERPAGE", "accession", "is_amendment", "amendment_type").drop("place")
    return subs.join(cover, "accession", "left"), of("INFOTABLE", "accession", "issuer", "cusip", "shares", "value", "kind", "put_call")


def filing_day(text):
    """A filed date, DD-MON-YYYY or YYYY-MM-DD, as a column."""
    return F.coalesce(F.try_to_timestamp(F.initcap(F.lower(text)), F.lit("dd-MMM-yyyy")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def filed_holdings(spark: SparkSession, path: str) -> DataFrame:
    """(quarter, cik, cusip, issuer, shares, value_usd) of filing archives: amendments applied, rows filtered, values in
    dollars, summed by position."""
    from ..operators import holdings as ho

    filings, rows = archives(spark, path)
    filings = filings.select("accession", "cik", quarter_of(filing_day(F.col("period"))).alias("period"), filing_day(F.col("filed")).alias("filed"), ho.amendment_kind(F.col("form"), F.col("is_amendment"), F.col("amendment_type")).alias("kind"))
    used = ho.apply_amendments(filings).select("accession").join(filings.select("accession", "cik", F.col("period").alias("quarter"), "filed"), "accession")
    own = ho.filed_rows(rows).join(used, "accession")
    own = own.select("quarter", "cik", "cusip", "issuer", "place", number(F.col("shares")).alias("shares"), value_to_usd(number(F.col("value")), F.col("filed")).alias("value_usd"))
    return ho.aggregate(own)


def choose_mapping(answers: DataFrame, preferred: tuple[str, ...]) -> DataFrame:
    """(cusip, ticker) of lookup answers (cusip, place, ticker, security_type): the first of a preferred type, else the
    first."""
    rank = F.when(F.col("security_type").isin(*preferred), 0).otherwise(1)
    return answers.groupBy("cusip").agg(F.min_by("ticker", F.struct(rank, F.col("place"))).alias("ticker"))


def synthetic_market(spark: SparkSession, sectors: int = 5, each: int = 10, bars: int = 300, seed: int = 42, turn: int = 150, drift: float = 0.003) -> DataFrame:
    """(t, bar_idx, ticker, sector, o, h, l, c, v, vw) of a made-up market: a common and a sector factor, noise, and money
    that moves from the first sector to the last from bar ``turn`` on. A ticker's path is drawn in its own group."""
    import numpy as np

    rng = np.random.default_rng(seed)
    common, factor = rng.standard_normal(bars) * 0.006, rng.standard_normal((sectors, bars)) * 0.006
    factor[0, turn:] -= drift
    factor[-1, turn:] += drift
    names = spark.createDataFrame([(s * each + k, s) for s in range(sectors) for k in range(each)], "ticker long, sector int")

    def run(pdf):
        import pandas as pd

        ticker, s = int(pdf["ticker"].iloc[0]), int(pdf["sector"].iloc[0])
        own = np.random.default_rng([seed, ticker])
        r = common + factor[s] + own.standard_normal(bars) * 0.01
        c = 50 * np.exp(np.cumsum(r))
        o = np.concatenate([[50.0], c[:-1]]) * np.exp(own.standard_normal(bars) * 0.001)
        span = np.abs(own.standard_normal(bars)) * 0.004
        v = 1e6 * np.exp(0.3 * own.standard_normal(bars) + 8 * np.abs(r))
        return pd.DataFrame({"bar_idx": np.arange(bars, dtype=np.int32), "ticker": ticker, "sector": s, "o": o, "h": np.maximum(o, c) * (1 + span), "l": np.minimum(o, c) * (1 - span), "c": c, "v": v, "vw": (o + c) / 2})

    rows = names.groupBy("ticker").applyInPandas(run, "bar_idx int, ticker long, sector int, o double, h double, l double, c double, v double, vw double")
    return rows.withColumn("t", F.col("bar_idx").cast("long") * TIMEFRAMES["1d"])


class Retry:
    """A vendor's answers by any transport (url -> (status, body)): throttled, and tried again with growing waits on a
    limit or a failure of the other side."""

    def __init__(self, transport, wait: float = 0.334, tries: int = 6, sleep=None):
        import time

        self.transport, self.wait, self.tries, self.sleep, self.requests = transport, wait, tries, sleep or time.sleep, 0

    def get(self, url: str) -> str | None:
        """The body, or None if all tries fail."""
        pause = 0.5
        for _ in range(self.tries):
            self.sleep(self.wait)
            self.requests += 1
            status, body = self.transport(url)
            if status == 200:
                return body
            if status != 429 and status < 500:
                return None
            self.sleep(pause)
            pause = min(30.0, pause * 2)
        return None

    def pages(self, url: str, token: str = "page_token"):
        """The bodies of all pages, following next_page_token; None at the end if one fails."""
        import json

        at = url
        while at:
            body = self.get(at)
            yield body
            more = json.loads(body).get("next_page_token") if body else None
            at = f"{url}&{token}={more}" if more else None


def months(start: int, end: int) -> list[tuple[int, int]]:
    """[start, end) in seconds, cut at the calendar's months."""
    out, at = [], start
    while at < end:
        d = datetime.utcfromtimestamp(at)
        nxt = datetime(d.year + d.month // 12, d.month % 12 + 1, 1)
        stop = min(end, at + int((nxt - d) / timedelta(seconds=1)))
        out.append((at, stop))
        at = stop
    return out
