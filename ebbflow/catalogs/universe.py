"""Queries of universes, sectors, scalars and the lake's catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import BARS, LAKE, _bars, _rows, final, out, query
from ..functions import scalar
from ..operators import universe as un
from ..sources import lake, tables

CASE = "CASE " + " ".join(f"WHEN code BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in un.SIC) + " ELSE '' END"
ASSETS = "WITH a AS (SELECT 'T' || p_partkey AS symbol, p_name || CASE p_partkey % 23 WHEN 0 THEN ' Warrant' WHEN 1 THEN ' Units' WHEN 2 THEN ' Bright Rights' WHEN 3 THEN ' iShares Core' WHEN 4 THEN ' Growth Funds' WHEN 5 THEN ' Fundamental' WHEN 6 THEN ' Index Trust' ELSE '' END AS name, CASE p_partkey % 7 WHEN 0 THEN 'OTC' WHEN 1 THEN 'NASDAQ' ELSE 'NYSE' END AS exchange, p_partkey % 11 <> 0 AS tradable, (p_partkey * 37) % 9000 AS code, p_size FROM part)"


def _assets(s, d):
    k = F.col("p_partkey")
    more = {0: " Warrant", 1: " Units", 2: " Bright Rights", 3: " iShares Core", 4: " Growth Funds", 5: " Fundamental", 6: " Index Trust"}
    tail = F.lit("")
    for n, text in more.items():
        tail = F.when(k % 23 == n, F.lit(text)).otherwise(tail)
    exchange = F.when(k % 7 == 0, "OTC").when(k % 7 == 1, "NASDAQ").otherwise("NYSE")
    return tables.table(s, d, "part").select(F.concat(F.lit("T"), k.cast("string")).alias("symbol"), F.concat("p_name", tail).alias("name"), exchange.alias("exchange"), (k % 11 != 0).alias("tradable"), (k * 37 % 9000).alias("code"), "p_size")


@query(ASSETS + " SELECT symbol FROM a WHERE tradable AND symbol NOT IN ('T5', 'T8') AND (symbol IN ('T14', 'T23') OR (exchange IN ('NYSE', 'NASDAQ', 'ARCA', 'NYSEARCA', 'AMEX', 'BATS') AND NOT regexp_matches(lower(name), 'warrant|\\bunits?\\b|\\brights?\\b')))")
def universe_rules(s, d):
    a = _assets(s, d)
    return a.where(un.passes_rules(F.col("symbol"), F.col("name"), F.col("exchange"), F.col("tradable"), ("T5", "T8"), ("T14", "T23"))).select("symbol")


@query(ASSETS + f" SELECT symbol, {CASE} AS sector FROM a")
def sic_sectors(s, d):
    """Sector of an industry code by the whole table of ranges."""
    return _assets(s, d).select("symbol", un.sic_sector(F.col("code")).alias("sector"))


@query("SELECT p_partkey, CASE WHEN p_size <= 9 THEN 'Agriculture' WHEN p_size <= 14 THEN 'Mining' WHEN p_size <= 17 THEN 'Construction' WHEN p_size <= 39 THEN 'Manufacturing' ELSE 'Services' END AS sector FROM part")
def sic_range_lookup(s, d):
    """First matching range of an ordered table of codes."""
    ranges = s.createDataFrame([(1, 0, 9, "Agriculture"), (2, 10, 14, "Mining"), (3, 15, 17, "Construction"), (4, 20, 39, "Manufacturing"), (5, 18, 19, "Manufacturing"), (6, 0, 9999, "Services")], "place int, lo int, hi int, sector string")
    return un.range_lookup(tables.table(s, d, "part").select("p_partkey", "p_size"), "p_size", ranges).select("p_partkey", "sector")


FUND = "(regexp_matches(lower(name), '(^|[^a-z])(etf|etn|fund)(s?([^a-z]|$))') OR contains(lower(name), 'ishares') OR contains(lower(name), 'spdr') OR contains(lower(name), 'proshares') OR contains(lower(name), 'invesco qqq') OR (regexp_matches(lower(name), '(^|[^a-z])trust(s?([^a-z]|$))') AND regexp_matches(lower(name), '(^|[^a-z])(index|shares)(s?([^a-z]|$))')))"


@query(ASSETS + f" SELECT symbol, coalesce(CASE WHEN p_size % 3 = 0 THEN 'Own' END, nullif(CASE WHEN p_size % 3 = 1 THEN {CASE} END, ''), CASE WHEN {FUND} THEN 'ETF/Fund' END, 'Unclassified') AS sector FROM a")
def sector_fill(s, d):
    """A node's own sector, that of its code, a fund's, or none."""
    a = _assets(s, d)
    k = F.col("p_size") % 3
    own = F.when(k == 0, F.lit("Own")).otherwise(F.lit("Unclassified"))
    return a.select("symbol", un.resolve_sector(own, F.when(k == 1, un.sic_sector(F.col("code"))), F.col("name"), F.lit(False)).alias("sector"))


@query(ASSETS + f" SELECT symbol, {FUND} AS fund FROM a")
def looks_like_fund(s, d):
    return _assets(s, d).select("symbol", scalar.looks_like_fund(F.col("name")).alias("fund"))


@query(final(BARS, "SELECT ticker, round(quantile_cont(v * vw, 0.5), 4) AS mdv, row_number() OVER (ORDER BY round(quantile_cont(v * vw, 0.5), 6) DESC, ticker) AS place FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_idx DESC) AS k FROM bars) WHERE k <= 20 GROUP BY ticker QUALIFY place <= 30"))
def liquidity_rank(s, d):
    return out(un.rank_by_liquidity(_bars(s, d), 20, 30), ["ticker", "place"], ["mdv"], 4)


@query(final(BARS, """ m AS (SELECT ticker, quantile_cont(v * vw, 0.5) AS mdv, count(*) AS days FROM bars WHERE t >= DATE '1994-01-01' AND t < DATE '1996-01-01' GROUP BY ticker)
SELECT ticker, days, round(mdv, 4) AS mdv, row_number() OVER (ORDER BY round(mdv, 6) DESC, ticker) AS place FROM m WHERE days >= 0.98::DOUBLE * (SELECT max(days) FROM m) QUALIFY place <= 25"""))
def coverage_rank(s, d):
    rows = un.rank_by_coverage(_bars(s, d), F.lit("1994-01-01").cast("date"), F.lit("1996-01-01").cast("date"), 25, 0.98)
    return out(rows, ["ticker", "days", "place"], ["mdv"], 4)


@query("""WITH s AS (SELECT s_suppkey AS place, 'S' || (s_suppkey % 40) AS ticker, s_name AS name, 'N' || s_nationkey AS sector FROM supplier), h AS (SELECT DISTINCT 'S' || (c_custkey % 60) AS ticker FROM customer), f AS (SELECT 'S' || x AS ticker FROM range(50, 55) r(x)),
o AS (SELECT ticker, 0 AS part, min(place) AS place, min_by(name, place) AS name, min_by(sector, place) AS sector FROM s GROUP BY ticker UNION ALL SELECT ticker, 1, 0, ticker, 'Extra' FROM h WHERE ticker NOT IN (SELECT ticker FROM s) AND ticker NOT IN (SELECT ticker FROM f))
SELECT row_number() OVER (ORDER BY part, place, ticker) - 1 AS i, ticker, name, sector FROM o""")
def universe_nodes(s, d):
    sup, c = tables.table(s, d, "supplier"), tables.table(s, d, "customer")
    sec = sup.select(F.col("s_suppkey").alias("place"), F.concat(F.lit("S"), (F.col("s_suppkey") % 40).cast("string")).alias("ticker"), F.col("s_name").alias("name"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("sector"))
    held = c.select(F.concat(F.lit("S"), (F.col("c_custkey") % 60).cast("string")).alias("ticker"))
    return un.nodes(sec, held, s.createDataFrame([(f"S{x}",) for x in range(50, 55)], "ticker string"))


@query("""WITH i AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'a' || c_custkey % 30 || '-b' WHEN 1 THEN 'a' || c_custkey % 30 || '.b' ELSE 'k' || c_custkey % 90 END AS ticker, c_custkey::VARCHAR AS cik FROM customer),
x AS (SELECT upper(ticker) AS ticker, 0 AS rank, cik FROM i UNION ALL SELECT replace(upper(ticker), '-', '.'), 1, cik FROM i UNION ALL SELECT replace(upper(ticker), '.', '-'), 1, cik FROM i)
SELECT ticker, cik FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY rank, cik) AS k FROM x) WHERE k = 1""")
def issuer_aliases(s, d):
    k = F.col("c_custkey")
    t = F.when(k % 4 == 0, F.concat(F.lit("a"), (k % 30).cast("string"), F.lit("-b"))).when(k % 4 == 1, F.concat(F.lit("a"), (k % 30).cast("string"), F.lit(".b"))).otherwise(F.concat(F.lit("k"), (k % 90).cast("string")))
    return un.aliases(tables.table(s, d, "customer").select(t.alias("ticker"), k.alias("cik")))


@query("WITH p AS (SELECT 'S' || s_suppkey AS ticker, s_acctbal + 1000 AS w FROM supplier WHERE s_suppkey <= 40) SELECT ticker, round(w / sum(w) OVER (), 9) AS weight FROM p")
def portfolio_weights(s, d):
    sup = tables.table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("ticker"), (F.col("s_acctbal") + 1000).alias("weight"), "s_suppkey")
    known = sup.select(F.upper("ticker").alias("ticker"))
    return out(un.portfolio(sup.where("s_suppkey <= 40").select("ticker", "weight"), known), ["ticker"], ["weight"], 9)


@query(LAKE + """, st AS (SELECT ticker, t, c FROM (SELECT *, row_number() OVER (PARTITION BY ticker, t ORDER BY seq DESC) AS k FROM rows) WHERE k = 1), nw AS (SELECT ticker, t, c * CASE WHEN ticker % 9 = 0 AND t % 5 = 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS c2 FROM st), dn AS (SELECT ticker, max(t) - 100 AS done FROM st GROUP BY ticker)
SELECT DISTINCT ticker FROM nw JOIN st USING (ticker, t) JOIN dn USING (ticker) WHERE t <= done AND abs(c2 - c) > 0.000001 * abs(c)""")
def readjusted(s, d):
    """Names whose refetched closes show a new adjustment."""
    st = lake.latest(_rows(s, d)).select("ticker", "t", "c")
    new = st.withColumn("c", F.col("c") * F.when((F.col("ticker") % 9 == 0) & (F.col("t") % 5 == 0), 1.5).otherwise(1.0))
    return un.readjusted(new, st, st.groupBy("ticker").agg((F.max("t") - 100).alias("t")))


@query("""WITH iv AS (SELECT o_custkey AS ticker, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))::BIGINT AS x, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))::BIGINT + 40 + o_orderkey % 200 AS y FROM orders), w AS (SELECT DISTINCT ticker, 8800::BIGINT + 10 * (ticker % 7) AS a, 8900::BIGINT + 10 * (ticker % 7) AS b FROM iv),
dy AS (SELECT w.*, a + i AS day FROM w CROSS JOIN range(100) r(i))
SELECT ticker, a, b, bool_and(EXISTS (SELECT 1 FROM iv WHERE iv.ticker = dy.ticker AND x <= day AND day < y)) AS covered FROM dy GROUP BY ticker, a, b""")
def interval_coverage(s, d):
    """Whether stored intervals cover a wanted one, day by day in the oracle."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    iv = tables.table(s, d, "orders").select(F.col("o_custkey").alias("ticker"), day.alias("x"), (day + 40 + F.col("o_orderkey") % 200).alias("y"))
    k = F.col("ticker") % 7 * 10
    return un.covered(iv, iv.select("ticker").distinct().select("ticker", (k + 8800).alias("a"), (k + 8900).alias("b")))


@query(LAKE + " SELECT DISTINCT ticker FROM rows")
def lake_tickers(s, d):
    return lake.tickers(_rows(s, d))


@query(LAKE + ", p AS (SELECT ticker, t, c + 1 AS c, 1000000000 + seq AS seq FROM rows WHERE ticker % 10 = 3 AND t % 2 = 0) SELECT ticker, t, round(c, 4) AS c FROM (SELECT *, row_number() OVER (PARTITION BY ticker, t ORDER BY seq DESC) AS k FROM (SELECT * FROM rows UNION ALL SELECT * FROM p)) WHERE k = 1 AND t BETWEEN 9000 AND 9400")
def lake_pending(s, d):
    """A window of the lake with rows that are not written yet; these win."""
    r = _rows(s, d)
    pending = r.where("ticker % 10 = 3 and t % 2 = 0").withColumns({"c": F.col("c") + 1, "seq": F.col("seq") + 1_000_000_000})
    return out(lake.with_pending(r, pending).where("t between 9000 and 9400"), ["ticker", "t"], ["c"], 4)


SEC = "SELECT o_orderkey, date_diff('second', TIMESTAMP '1970-01-01', CAST(o_orderdate AS TIMESTAMP))::BIGINT + o_orderkey % 86400 AS t FROM orders"


@query(f"WITH x AS ({SEC}) SELECT o_orderkey, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS text, t AS back, year(make_timestamp(t * 1000000))::BIGINT AS y, dayofweek(make_timestamp(t * 1000000))::BIGINT AS weekday, (t // 86400) * 86400 AS day_start FROM x")
def time_texts(s, d):
    """Times as text and back, their civil date and the start of their day."""
    o = tables.table(s, d, "orders")
    t = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400
    rows = o.select("o_orderkey", t.alias("t")).withColumn("text", scalar.format_rfc3339(F.col("t")))
    c = scalar.civil(F.col("t"))
    return rows.select("o_orderkey", "text", scalar.parse_rfc3339(F.col("text")).alias("back"), c["y"].cast("long").alias("y"), c["weekday"].cast("long").alias("weekday"), scalar.parse_day_start(F.substring("text", 1, 10)).alias("day_start"))


@query("""WITH q AS (SELECT DISTINCT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q, date_trunc('quarter', o_orderdate) AS s FROM orders), a AS (SELECT list(q) AS l FROM q WHERE q <> '1994Q2'),
n AS (SELECT q, epoch(s)::BIGINT AS start, epoch(s + INTERVAL 3 MONTH)::BIGINT AS stop, year(s - INTERVAL 3 MONTH) || 'Q' || quarter(s - INTERVAL 3 MONTH) AS prev, year(s + INTERVAL 3 MONTH) || 'Q' || quarter(s + INTERVAL 3 MONTH) AS next, year(s - INTERVAL 1 YEAR) || 'Q' || quarter(s) AS ago FROM q)
SELECT q, start, stop, prev, next, CASE WHEN list_contains(l, ago) THEN ago WHEN list_contains(l, next) THEN next WHEN list_contains(l, prev) THEN prev ELSE '' END AS placebo FROM n CROSS JOIN a""")
def quarters(s, d):
    o = tables.table(s, d, "orders").select(scalar.quarter_of(F.col("o_orderdate")).alias("q")).distinct()
    known = o.where("q <> '1994Q2'").agg(F.collect_set("q").alias("l"))  # one short list
    q = F.col("q")
    b = scalar.quarter_bounds(q)
    return o.crossJoin(known).select("q", b["start"].alias("start"), b["end"].alias("stop"), scalar.shift_quarter(q, -1).alias("prev"), scalar.shift_quarter(q, 1).alias("next"), scalar.placebo_quarter(q, F.col("l")).alias("placebo"))


@query("""SELECT p_partkey, upper(replace(trim(p_brand || '/a '), '/', '.')) AS ticker, upper(trim(' ' || p_type)) AS cusip, CASE WHEN regexp_matches(p_name || ', "x"', '[,"\n]') THEN '"' || replace(p_name || ', "x"', '"', '""') || '"' END AS field, '''' || replace(p_name || '''s', '''', '''''') || '''' AS lit FROM part""")
def text_helpers(s, d):
    p = tables.table(s, d, "part")
    return p.select("p_partkey", scalar.normalise_ticker(F.concat("p_brand", F.lit("/a "))).alias("ticker"), scalar.clean_cusip(F.concat(F.lit(" "), F.col("p_type"))).alias("cusip"), scalar.csv_field(F.concat("p_name", F.lit(', "x"'))).alias("field"), scalar.sql_str(F.concat("p_name", F.lit("'s"))).alias("lit"))


@query(final(BARS, "SELECT ticker, bar_idx::BIGINT AS bar_idx, round(CASE WHEN r >= 0 THEN ln(1 + r) ELSE -ln(1 - r) END, 8) AS height, CASE WHEN abs(ln(v * vw / 1000) - k * ln(10)) < ln(3) THEN k ELSE 0 END::BIGINT AS decades FROM (SELECT *, 3 * round(ln(v * vw / 1000) / (3 * ln(10)))::INT AS k FROM rets WHERE r IS NOT NULL)"))
def heights_and_units(s, d):
    """Shown heights of returns and the powers of a thousand of dollar volumes."""
    from ..operators import panel

    rets = panel.returns(_bars(s, d)).where("r is not null")
    dev = F.ln(F.col("v") * F.col("vw") / 1000)
    return out(rets.select("ticker", "bar_idx", scalar.display_height(F.col("r")).alias("height"), scalar.decades(dev).alias("decades")), ["ticker", "bar_idx", "decades"], ["height"], 8)
