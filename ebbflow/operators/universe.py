"""The universe of nodes: which assets belong to it, their sector, their order by liquidity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

#: The exchanges of the universe, and the names that are left out of it.
EXCHANGES = ("NYSE", "NASDAQ", "ARCA", "NYSEARCA", "AMEX", "BATS")
LEFT_OUT = r"(?i)warrant|\bunits?\b|\brights?\b"

#: Industry codes by sector, the first matching range counts.
SIC = (
    (6798, 6798, "Real Estate"), (6324, 6324, "Health Care"), (1220, 1241, "Energy"), (4922, 4924, "Energy"), (3020, 3029, "Consumer Discretionary"),
    (3826, 3826, "Health Care"), (3829, 3829, "Health Care"), (7311, 7311, "Communication Services"), (7812, 7841, "Communication Services"), (5331, 5331, "Consumer Staples"),
    (5399, 5399, "Consumer Staples"), (5400, 5499, "Consumer Staples"), (7389, 7389, "Industrials"), (6770, 6770, "Financials"), (6500, 6553, "Real Estate"),
    (2833, 2836, "Health Care"), (2840, 2844, "Consumer Staples"), (3841, 3851, "Health Care"), (8731, 8731, "Health Care"), (5122, 5122, "Health Care"),
    (5047, 5047, "Health Care"), (5171, 5172, "Energy"), (5912, 5912, "Consumer Staples"), (5140, 5149, "Consumer Staples"), (5150, 5159, "Consumer Staples"),
    (3570, 3579, "Information Technology"), (3661, 3669, "Information Technology"), (3670, 3679, "Information Technology"), (7370, 7379, "Information Technology"),
    (3711, 3716, "Consumer Discretionary"), (3751, 3751, "Consumer Discretionary"), (3790, 3799, "Consumer Discretionary"), (3011, 3011, "Consumer Discretionary"),
    (3630, 3639, "Consumer Discretionary"), (1520, 1531, "Consumer Discretionary"), (100, 999, "Consumer Staples"), (1000, 1299, "Materials"), (1300, 1399, "Energy"),
    (1400, 1499, "Materials"), (1500, 1799, "Industrials"), (2000, 2199, "Consumer Staples"), (2200, 2399, "Consumer Discretionary"), (2400, 2499, "Materials"),
    (2500, 2599, "Consumer Discretionary"), (2600, 2699, "Materials"), (2700, 2799, "Communication Services"), (2800, 2829, "Materials"), (2845, 2899, "Materials"),
    (2900, 2999, "Energy"), (3000, 3099, "Materials"), (3100, 3199, "Consumer Discretionary"), (3200, 3299, "Materials"), (3300, 3399, "Materials"),
    (3400, 3599, "Industrials"), (3600, 3699, "Industrials"), (3700, 3799, "Industrials"), (3800, 3899, "Industrials"), (3900, 3999, "Consumer Discretionary"),
    (4000, 4599, "Industrials"), (4600, 4699, "Energy"), (4700, 4799, "Industrials"), (4800, 4899, "Communication Services"), (4900, 4949, "Utilities"),
    (4950, 4999, "Industrials"), (5000, 5199, "Industrials"), (5200, 5999, "Consumer Discretionary"), (6000, 6499, "Financials"), (6700, 6799, "Financials"),
    (7000, 7099, "Consumer Discretionary"), (7200, 7299, "Consumer Discretionary"), (7300, 7369, "Industrials"), (7380, 7399, "Industrials"), (7500, 7599, "Consumer Discretionary"),
    (7600, 7699, "Industrials"), (7830, 7999, "Consumer Discretionary"), (8000, 8099, "Health Care"), (8100, 8199, "Industrials"), (8200, 8299, "Consumer Discretionary"),
    (8300, 8699, "Industrials"), (8700, 8799, "Industrials"),
)


def passes_rules(symbol, name, exchange, tradable, exclude: tuple[str, ...] = (), include: tuple[str, ...] = ()):
    """Whether an asset belongs to the universe, as a column: tradable, not excluded, and always included or on one of the
    exchanges with a name that is none of a warrant, unit or right."""
    listed = exchange.isin(*EXCHANGES) & ~F.coalesce(name, F.lit("")).rlike(LEFT_OUT)
    out = tradable & ~symbol.isin(*exclude) if exclude else tradable
    return F.coalesce(out & (symbol.isin(*include) | listed if include else listed), F.lit(False))


def sic_sector(code, ranges=SIC):
    """Sector of an industry code, as a column: the first range that holds it; '' where none does."""
    out = F.lit("")
    for lo, hi, sector in reversed(ranges):
        out = F.when(code.between(lo, hi), F.lit(sector)).otherwise(out)
    return out


def range_lookup(df: DataFrame, code: str, ranges: DataFrame) -> DataFrame:
    """``df`` with the sector of the first (by place) of ``ranges`` (place, lo, hi, sector) that holds its code; null where
    none does. Ranges are a small table; the codes of many rows are few, so they are looked up once each."""
    codes = df.select(F.col(code).alias("code")).distinct()
    hit = codes.join(F.broadcast(ranges), F.col("code").between(F.col("lo"), F.col("hi"))).groupBy("code").agg(F.min_by("sector", "place").alias("sector"))
    return df.join(hit, df[code] == hit["code"], "left").drop("code")


def resolve_sector(sector, by_code, name, known_fund):
    """A node's own sector, else that of its code, else a fund's, else none, as a column."""
    own = F.when(F.coalesce(sector, F.lit("")).isin("", "Unclassified"), None).otherwise(sector)
    return F.coalesce(own, F.nullif(by_code, F.lit("")), F.when(known_fund | scalar.looks_like_fund(name), F.lit("ETF/Fund")), F.lit("Unclassified"))


def rank_by_liquidity(bars: DataFrame, window: int, n: int, digits: int = 6) -> DataFrame:
    """(ticker, mdv, place): the ``n`` largest medians of v * vw (of the close, where vw is 0) over the last ``window``
    recorded bars; ties to the smaller symbol."""
    last = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("t")))
    dv = F.col("v") * F.when(F.col("vw") > 0, F.col("vw")).otherwise(F.col("c"))
    med = bars.withColumn("k", last).where(F.col("k") <= window).groupBy("ticker").agg(F.percentile(dv, F.lit(0.5)).alias("mdv"))
    return first(med.withColumn("key", F.round("mdv", digits)), n)


def rank_by_coverage(bars: DataFrame, start, end, n: int, coverage: float, digits: int = 6) -> DataFrame:
    """(ticker, mdv, days, place): as ``rank_by_liquidity`` over [start, end), for names with at least ``coverage`` of the
    days of the one that has most."""
    dv = F.col("v") * F.when(F.col("vw") > 0, F.col("vw")).otherwise(F.col("c"))
    med = bars.where((F.col("t") >= start) & (F.col("t") < end)).withColumn("dv", dv).where("dv is not null").groupBy("ticker").agg(F.percentile("dv", F.lit(0.5)).alias("mdv"), F.count("*").alias("days"))
    most = med.agg(F.max("days").alias("most"))
    return first(med.crossJoin(most).where(F.col("days") >= coverage * F.col("most")).drop("most").withColumn("key", F.round("mdv", digits)), n)  # one row


def first(med: DataFrame, n: int) -> DataFrame:
    best = med.orderBy(F.desc("key"), "ticker").limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("key"), "ticker"))).drop("key")  # n rows


def nodes(securities: DataFrame, held: DataFrame | None = None, funds: DataFrame | None = None) -> DataFrame:
    """(i, ticker, name, sector): securities (place, ticker, name, sector), the first of each ticker; then the held names
    (ticker) that are neither nodes nor funds, with the sector Extra; numbered in that order."""
    own = securities.groupBy("ticker").agg(F.min_by(F.struct("place", "name", "sector"), "place").alias("x")).select("ticker", F.lit(0).alias("part"), "x.place", "x.name", "x.sector")
    if held is not None:
        more = held.select("ticker").distinct().join(own, "ticker", "left_anti")
        more = more if funds is None else more.join(funds.select("ticker"), "ticker", "left_anti")
        own = own.unionByName(more.select("ticker", F.lit(1).alias("part"), F.lit(0).cast(own.schema["place"].dataType).alias("place"), F.col("ticker").alias("name"), F.lit("Extra").alias("sector")))
    return own.select((F.row_number().over(Window.orderBy("part", "place", "ticker")) - 1).cast("long").alias("i"), "ticker", "name", "sector")  # a universe of names


def price_tickers(universe: DataFrame, funds: DataFrame) -> DataFrame:
    """(ticker): the nodes, and the funds that are none of them."""
    return universe.select("ticker").unionByName(funds.select("ticker").distinct().join(universe, "ticker", "left_anti"))


def aliases(issuers: DataFrame) -> DataFrame:
    """(ticker, cik) of issuers (ticker, cik) with dotted and dashed spellings, which never displace a real one."""
    up = issuers.select(F.upper("ticker").alias("t"), F.col("cik").cast("string").alias("cik")).where("t <> ''")
    spelt = F.explode(F.array(F.struct(F.col("t").alias("ticker"), F.lit(0).alias("rank")), F.struct(F.replace("t", F.lit("-"), F.lit(".")).alias("ticker"), F.lit(1).alias("rank")), F.struct(F.replace("t", F.lit("."), F.lit("-")).alias("ticker"), F.lit(1).alias("rank"))))
    return up.select(spelt.alias("x"), "cik").select("x.ticker", "x.rank", "cik").groupBy("ticker").agg(F.min(F.struct("rank", "cik")).alias("x")).select("ticker", "x.cik")


def portfolio(holdings: DataFrame, known: DataFrame) -> DataFrame:
    """(ticker, weight) of a portfolio update: upper case, scaled to sum 1. Raises for a weight that is not positive, an
    unknown ticker or one that comes twice, and for none or more than fifty."""
    rows = holdings.select(F.upper("ticker").alias("ticker"), "weight")
    bad = rows.join(F.broadcast(known.select(F.col("ticker"), F.lit(1).alias("known"))), "ticker", "left").groupBy("ticker").agg(F.count("*").alias("n"), F.min("weight").alias("least"), F.max("known").alias("known"))
    state = bad.agg(F.count("*").alias("names"), F.sum("n").alias("n"), F.count(F.when(F.col("least") > 0, 1)).alias("fine"), F.count("known").alias("known")).first()
    if not state.names or state.n > 50 or state.n != state.names or state.fine != state.names or state.known != state.names:
        raise ValueError("a portfolio needs 1 to 50 known tickers, each once, with positive weights")
    return rows.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0))))  # fifty rows at most


def readjusted(new: DataFrame, stored: DataFrame, complete: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(ticker): names whose refetched close differs from the stored one on a bar that was complete when stored."""
    both = new.select("ticker", "t", F.col("c").alias("c2")).join(stored.select("ticker", "t", "c"), ["ticker", "t"]).join(complete.select("ticker", F.col("t").alias("done")), "ticker")
    return both.where((F.col("t") <= F.col("done")) & (F.abs(F.col("c2") - F.col("c")) > tolerance * F.abs(F.col("c")))).select("ticker").distinct()


def covered(intervals: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ticker, a, b, covered): whether the wanted [a, b) lies in the union of the ticker's intervals (ticker, x, y)."""
    at = wanted.join(intervals, "ticker", "left").where("x is null or (x < b and y > a)")
    w = Window.partitionBy("ticker", "a", "b").orderBy("x", "y")
    reach = F.greatest(F.col("a"), F.coalesce(F.max("y").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("a")))
    rows = at.withColumn("gap", F.col("x") > reach)
    whole = rows.groupBy("ticker", "a", "b").agg((F.coalesce(F.max("y") >= F.col("b"), F.lit(False)) & ~F.coalesce(F.max("gap"), F.lit(True))).alias("covered"))
    return wanted.join(whole, ["ticker", "a", "b"], "left").withColumn("covered", F.coalesce("covered", F.col("a") >= F.col("b")))
