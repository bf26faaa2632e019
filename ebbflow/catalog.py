"""All registered queries of the engine, each with an independent oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import flux, graph, holdings, panel, sessions, stats, walkforward
from .sources import lake, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def out(df: DataFrame, keys: list[str], values: list[str] = (), digits: int = 6) -> DataFrame:
    """Keys as they are (whole numbers as long), values as doubles rounded for comparison."""
    kinds = dict(df.dtypes)
    k = [F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint", "smallint") else F.col(c) for c in keys]
    return df.select(*k, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in values])


def r(cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c.strip()}::DOUBLE, {digits}) AS {c.strip()}" for c in cols.split(","))


# --- building blocks of the oracle -------------------------------------------------------------------------------
BARS = """WITH li AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS t, l_suppkey AS ticker, l_extendedprice / l_quantity AS price, l_quantity AS q, l_extendedprice AS x, l_shipdate, l_orderkey, l_linenumber FROM lineitem),
b0 AS (SELECT t, ticker, first(price ORDER BY l_shipdate, l_orderkey, l_linenumber) AS o, max(price) AS h, min(price) AS l, last(price ORDER BY l_shipdate, l_orderkey, l_linenumber) AS c, sum(q) AS v, sum(x) / sum(q) AS vw FROM li GROUP BY t, ticker),
cal AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS bar_idx FROM (SELECT DISTINCT t FROM b0)),
bars AS (SELECT b0.*, bar_idx FROM b0 JOIN cal USING (t)),
grid AS (SELECT ticker, t, bar_idx, o, h, l, c, v, vw FROM (SELECT DISTINCT ticker FROM b0) CROSS JOIN cal LEFT JOIN b0 USING (ticker, t)),
rets AS (SELECT *, CASE WHEN bar_idx - lag(bar_idx) OVER w = 1 AND lag(c) OVER w > 0 THEN c / lag(c) OVER w - 1 END AS r FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY bar_idx)),
p AS (SELECT bar_idx, ticker, coalesce(r * v * vw, 0) AS p FROM rets),"""
FLUX = (
    BARS
    + """
tot AS (SELECT bar_idx, sum(p) AS total FROM p WHERE p > 0 GROUP BY bar_idx),
snk AS (SELECT bar_idx, ticker AS dst, p AS pd, row_number() OVER (PARTITION BY bar_idx ORDER BY p DESC, ticker) AS place FROM p WHERE p > 0),
flux AS (SELECT p.bar_idx, p.ticker AS src, dst, -p.p * pd / total AS w FROM p JOIN tot USING (bar_idx) JOIN snk USING (bar_idx) WHERE p.p < 0 AND place <= 64),
mar AS (SELECT bar_idx, ticker, CASE WHEN p < 0 THEN -p ELSE 0 END AS outflow, CASE WHEN p > 0 THEN p * sell / buy ELSE 0 END AS inflow
        FROM (SELECT *, sum(CASE WHEN p < 0 THEN -p ELSE 0 END) OVER (PARTITION BY bar_idx) AS sell, sum(CASE WHEN p > 0 THEN p ELSE 0 END) OVER (PARTITION BY bar_idx) AS buy FROM p) WHERE buy > 0),
mg AS (SELECT ticker AS node, sum(outflow) AS outflow, sum(inflow) AS inflow FROM mar GROUP BY ticker),
acc AS (SELECT src, dst, sum(w) AS w FROM flux GROUP BY src, dst),
top AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS ko, row_number() OVER (PARTITION BY dst ORDER BY w DESC, src) AS ki FROM acc WHERE src <> dst AND w > 0) WHERE ko <= 20 OR ki <= 10),
tr AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM top),
nodes AS (SELECT DISTINCT ticker AS node FROM b0),"""
)


def pi_steps(n: int, graph_: str = "tr", name: str = "pi") -> str:
    """Damped steps, one table each, from uniform."""
    sql = f"\n{name}0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS pi FROM nodes),"
    for i in range(n):
        a = f"{name}{i}"
        sql += f"""
{name}x{i} AS MATERIALIZED (SELECT node, 0.85::DOUBLE * (coalesce(x, 0) + (SELECT coalesce(sum(pi), 0) FROM {a} WHERE node NOT IN (SELECT src FROM {graph_})) / (SELECT count(*) FROM nodes)) + 0.15::DOUBLE / (SELECT count(*) FROM nodes) AS pi
  FROM {a} LEFT JOIN (SELECT dst, sum(pi * p) AS x FROM {a} JOIN {graph_} ON node = src GROUP BY dst) ON node = dst),
{name}{i + 1} AS MATERIALIZED (SELECT node, pi / (SELECT sum(pi) FROM {name}x{i}) AS pi FROM {name}x{i}),"""
    return sql


def final(sql: str, last: str) -> str:
    """``sql`` ends in a comma; ``last`` is a query, or more tables and a query."""
    more = not last.lstrip().upper().startswith(("SELECT", ","))
    return (sql.rstrip() if more else sql.rstrip().rstrip(",")) + "\n" + last


PI7 = FLUX + pi_steps(7)


# --- domain objects ----------------------------------------------------------------------------------------------
def _bars(s, d):
    return tables.panel(tables.bars_monthly(s, d))


def _rets(s, d):
    return panel.returns(_bars(s, d))


def _p(s, d, mode="dollar"):
    return panel.pressure(_rets(s, d), mode).select("bar_idx", "ticker", "p")


def _flux(s, d):
    return flux.bar_flux(_p(s, d))


def _acc(s, d):
    return _flux(s, d).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _margin(s, d):
    return flux.margins(_p(s, d)).groupBy(F.col("ticker").alias("node")).agg(F.sum("outflow").alias("outflow"), F.sum("inflow").alias("inflow"))


def _nodes(s, d):
    return tables.table(s, d, "lineitem").select(F.col("l_suppkey").alias("node")).distinct()


def _pi(s, d, steps=7):
    return flux.stationary(_nodes(s, d), flux.transition(_acc(s, d)), steps=steps)


@query(final(BARS, f"SELECT t, ticker, bar_idx, {r('o, h, l, c, v, vw', 9)} FROM bars"))
def bars_monthly(s, d):
    return out(_bars(s, d), ["t", "ticker", "bar_idx"], ["o", "h", "l", "c", "v", "vw"], 9)


@query(final(BARS, f"SELECT ticker, bar_idx, {r('c, v', 9)} FROM grid"))
def panel_dense(s, d):
    return out(tables.dense(_bars(s, d)), ["ticker", "bar_idx"], ["c", "v"], 9)


@query(final(BARS, f"SELECT ticker, bar_idx, {r('r')} FROM rets"))
def returns_adjacent(s, d):
    return out(_rets(s, d), ["ticker", "bar_idx"], ["r"])


@query(final(BARS, "SELECT ticker, bar_idx, round(quantile_cont(v * vw, 0.5) OVER (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS mdv FROM bars"))
def median_dollar_volume20(s, d):
    return out(panel.median_dollar_volume(_bars(s, d)), ["ticker", "bar_idx"], ["mdv"])


@query(final(BARS, "SELECT ticker, bar_idx, round(quantile_cont(v, 0.5) OVER (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS adv FROM bars"))
def adv_median20(s, d):
    return out(panel.adv(_bars(s, d)), ["ticker", "bar_idx"], ["adv"])


@query(final(BARS, "SELECT ticker, bar_idx, round(CASE WHEN count(r) OVER w >= 5 THEN 1 / greatest(stddev_samp(r) OVER w, 0.0001) ELSE 0 END::DOUBLE, 6) AS scale FROM rets WHERE r IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"))
def vol_scale20(s, d):
    return out(panel.vol_scale(_rets(s, d)), ["ticker", "bar_idx"], ["scale"])


@query(final(BARS, f"SELECT ticker, bar_idx, {r('p', 4)} FROM p"))
def pressure_dollar(s, d):
    return out(_p(s, d), ["ticker", "bar_idx"], ["p"], 4)


@query(final(BARS, "SELECT ticker, bar_idx, round(coalesce(r * sqrt(v * vw), 0)::DOUBLE, 6) AS p FROM rets"))
def pressure_sqrt(s, d):
    return out(_p(s, d, "sqrt"), ["ticker", "bar_idx"], ["p"])


@query(final(BARS, "SELECT ticker, bar_idx, round(coalesce(r * least(v / adv, 5.0), 0)::DOUBLE, 6) AS p FROM (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS adv FROM rets)"))
def pressure_relative(s, d):
    return out(panel.pressure(panel.adv(_rets(s, d)).where("adv is null or adv <> 0"), "relative"), ["ticker", "bar_idx"], ["p"])


@query(final(BARS, """SELECT ticker, bar_idx, coalesce(bar_idx - seen <= 5 AND med >= 200000, false) AS active FROM (
SELECT ticker, bar_idx, last_value(CASE WHEN c IS NOT NULL THEN bar_idx END IGNORE NULLS) OVER w AS seen, last_value(mdv IGNORE NULLS) OVER w AS med FROM grid
LEFT JOIN (SELECT ticker, bar_idx, quantile_cont(v * vw, 0.5) OVER (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mdv FROM bars) m USING (ticker, bar_idx)
WINDOW w AS (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""))
def active_mask(s, d):
    grid = tables.dense(panel.median_dollar_volume(_bars(s, d)))
    return out(panel.active_mask(grid, 200_000.0), ["ticker", "bar_idx", "active"])


@query(final(BARS, """SELECT ticker, bar_idx, place FROM (SELECT ticker, bar_idx, row_number() OVER (PARTITION BY bar_idx ORDER BY med DESC, ticker) AS place FROM (
SELECT ticker, bar_idx, quantile_cont(v * vw, 0.5) OVER w AS med, count(v * vw) OVER w AS n FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE n >= 10 AND med >= 100000) WHERE place <= 50"""))
def eligible_topn(s, d):
    return out(panel.eligible(tables.dense(_bars(s, d)), 20, 100_000.0, 50), ["ticker", "bar_idx", "place"])


@query(final(BARS, "SELECT bar_idx FROM (SELECT max(bar_idx) AS bar_idx FROM cal GROUP BY date_trunc('quarter', t)) WHERE bar_idx >= 12 AND bar_idx <= (SELECT max(bar_idx) - 1 FROM cal)"))
def rebalance_quarterly(s, d):
    return out(panel.rebalance_dates(_bars(s, d), "quarter", 12), ["bar_idx"])


@query(final(BARS, "SELECT bar_idx FROM (SELECT max(bar_idx) AS bar_idx FROM cal GROUP BY date_trunc('year', t)) WHERE bar_idx >= 12 AND bar_idx <= (SELECT max(bar_idx) - 1 FROM cal)"))
def rebalance_yearly(s, d):
    return out(panel.rebalance_dates(_bars(s, d), "year", 12), ["bar_idx"])


FWD = BARS + " fwd AS (SELECT *, CASE WHEN lead(o, 1) OVER w > 0 THEN lead(o, 4) OVER w / lead(o, 1) OVER w - 1 END AS fwd FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY bar_idx)),"


@query(final(FWD, f"SELECT ticker, bar_idx, {r('fwd')} FROM fwd"))
def forward_oo_return(s, d):
    return out(panel.forward_return(tables.dense(_bars(s, d)), 3), ["ticker", "bar_idx"], ["fwd"])


#: The pairs of the first twelve tickers alone: a test holds these rows of ``rolling_corr`` against it.
ROLLING_CORR_12 = final(BARS, """SELECT x.bar_idx, x.ticker AS a, y.ticker AS b, round(corr, 6) AS corr FROM (
SELECT *, corr(x.r0, y.r0) OVER w AS corr, count(*) OVER w AS n FROM (SELECT bar_idx, ticker, coalesce(r, 0) AS r0 FROM rets WHERE ticker <= 12) x JOIN (SELECT bar_idx, ticker, coalesce(r, 0) AS r0 FROM rets WHERE ticker <= 12) y ON x.bar_idx = y.bar_idx AND x.ticker < y.ticker
WINDOW w AS (PARTITION BY x.ticker, y.ticker ORDER BY x.bar_idx RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE n = 12""".replace("SELECT x.bar_idx, x.ticker AS a, y.ticker AS b, round(corr, 6) AS corr FROM (\nSELECT *, ", "SELECT bar_idx, a, b, round(corr, 6) AS corr FROM (\nSELECT x.bar_idx AS bar_idx, x.ticker AS a, y.ticker AS b, "))


@query(ROLLING_CORR_12.replace(" WHERE ticker <= 12", ""))
def rolling_corr(s, d):
    return out(panel.rolling_corr(_rets(s, d), 12), ["bar_idx", "a", "b"], ["corr"])


@query(final(BARS, """SELECT ticker, bar_idx, round(CASE WHEN n1 >= 10 THEN cv / m END::DOUBLE, 6) AS dvshock, round(CASE WHEN cv > 0 THEN ln(cv) END::DOUBLE, 6) AS ldv, round(ret1::DOUBLE, 6) AS ret1, round(CASE WHEN count(ret1) OVER w >= 10 THEN stddev_samp(ret1) OVER w END::DOUBLE, 6) AS vol20 FROM (
SELECT ticker, bar_idx, c * v AS cv, CASE WHEN bar_idx - lag(bar_idx) OVER o = 1 THEN ln(c / lag(c) OVER o) END AS ret1, quantile_cont(c * v, 0.5) OVER b AS m, count(c * v) OVER b AS n1 FROM bars
WINDOW o AS (PARTITION BY ticker ORDER BY bar_idx), b AS (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
WINDOW w AS (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""))
def panel_features(s, d):
    return out(panel.features(_bars(s, d)), ["ticker", "bar_idx"], ["ret1", "ldv", "dvshock", "vol20"])


# --- flow graph --------------------------------------------------------------------------------------------------
@query(final(FLUX, f"SELECT bar_idx, src, dst, {r('w', 4)} FROM flux"))
def bar_flux(s, d):
    return out(_flux(s, d), ["bar_idx", "src", "dst"], ["w"], 4)


@query(final(FLUX, f"SELECT bar_idx, ticker, {r('outflow, inflow', 4)} FROM mar"))
def flux_margins(s, d):
    return out(flux.margins(_p(s, d)), ["bar_idx", "ticker"], ["outflow", "inflow"], 4)


def _decayed(half_life: float) -> str:
    return final(FLUX, f"SELECT src, dst, round(sum(w * pow(2.0::DOUBLE, -((SELECT max(bar_idx) FROM cal) - bar_idx) / {half_life}::DOUBLE)), 4) AS w FROM flux GROUP BY src, dst")


def _last(bars: DataFrame) -> int:
    return bars.agg(F.max("bar_idx")).first()[0] or 0


@query(_decayed(20))
def accumulated_slow(s, d):
    return out(flux.accumulate(_flux(s, d), _last(_bars(s, d)), 20), ["src", "dst"], ["w"], 4)


@query(_decayed(3))
def accumulated_fast(s, d):
    return out(flux.accumulate(_flux(s, d), _last(_bars(s, d)), 3), ["src", "dst"], ["w"], 4)


@query(final(FLUX, f"SELECT src, dst, {r('p', 8)} FROM tr"))
def transition_topk(s, d):
    return out(flux.transition(_acc(s, d)), ["src", "dst"], ["p"], 8)


def _lifted(score: str) -> str:
    return final(
        FLUX,
        f"""SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 7) AS p FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS ko, row_number() OVER (PARTITION BY dst ORDER BY w DESC, src) AS ki FROM (
SELECT src, dst, {score} AS w FROM acc JOIN mg a ON a.node = src JOIN mg b ON b.node = dst CROSS JOIN (SELECT sum(outflow) AS total FROM mg)) WHERE w > 0 AND src <> dst) WHERE ko <= 20 OR ki <= 10""",
    )


@query(_lifted("w - a.outflow * b.inflow / total"))
def transition_excess_lift(s, d):
    return out(flux.transition(flux.lift(_acc(s, d), _margin(s, d), "excess")), ["src", "dst"], ["p"], 7)


@query(_lifted("w / (a.outflow * b.inflow / total) - 1"))
def transition_ratio_lift(s, d):
    return out(flux.transition(flux.lift(_acc(s, d), _margin(s, d), "ratio")), ["src", "dst"], ["p"], 7)


@query(final(FLUX, """SELECT src, dst, round(p * (1 - inflow / (outflow + inflow)), 8) AS p FROM tr JOIN mg ON node = src UNION ALL SELECT node, node, round(inflow / (outflow + inflow), 8) FROM mg WHERE node IN (SELECT src FROM tr) AND inflow > 0"""))
def transition_retention(s, d):
    return out(flux.transition(_acc(s, d), margin=_margin(s, d), retention=1.0), ["src", "dst"], ["p"], 8)


@query(final(FLUX + pi_steps(1), f"SELECT node, {r('pi', 9)} FROM pi1"))
def damped_step(s, d):
    nodes = _nodes(s, d)
    start = nodes.crossJoin(nodes.agg((1 / F.count("*")).alias("pi")))  # one row
    return out(flux.damped_step(start, flux.transition(_acc(s, d))), ["node"], ["pi"], 9)


@query(final(PI7, f"SELECT node, {r('pi', 9)} FROM pi7"))
def stationary_7(s, d):
    return out(_pi(s, d), ["node"], ["pi"], 9)


@query(final(PI7, "SELECT node, round(pi * (SELECT count(*) FROM nodes) - 1, 7) AS hot FROM pi7"))
def hotness_uniform(s, d):
    return out(flux.hotness(_pi(s, d)), ["node"], ["hot"], 7)


@query(final(PI7, "SELECT node, round(pi / greatest(ref / (SELECT sum(ref) FROM rf), 1e-12) - 1, 7) AS hot FROM pi7 JOIN rf USING (node)".replace("SELECT node, round", ", rf AS (SELECT ticker AS node, sum(v * vw) AS ref FROM bars GROUP BY ticker) SELECT node, round", 1)))
def hotness_size(s, d):
    ref = _bars(s, d).groupBy(F.col("ticker").alias("node")).agg(F.sum(F.col("v") * F.col("vw")).alias("ref"))
    return out(flux.relative_hotness(_pi(s, d), ref), ["node"], ["hot"], 7)


@query(final(FLUX, "SELECT node, round((inflow - outflow) / (inflow + outflow + (SELECT quantile_cont(inflow + outflow, 0.5) FROM mg)), 7) AS hot FROM mg"))
def hotness_netflow(s, d):
    return out(flux.net_flow_hotness(_margin(s, d)), ["node"], ["hot"], 7)


@query(final(PI7, "SELECT node, round((SELECT count(*) FROM nodes) * (pi7.pi - pi6.pi), 8) AS forecast FROM pi7 JOIN pi6 USING (node)"))
def forecast_k1(s, d):
    """What one more step moves: N (pi_7 - pi_6)."""
    p = flux.transition(_acc(s, d))
    nodes = _nodes(s, d)
    a, b = flux.stationary(nodes, p, steps=7), flux.stationary(nodes, p, steps=6).withColumnRenamed("pi", "was")
    rows = a.join(b, "node").crossJoin(nodes.agg(F.count("*").alias("n")))
    return out(rows.select("node", (F.col("n") * (F.col("pi") - F.col("was"))).alias("forecast")), ["node"], ["forecast"], 8)


@query(final(FLUX, "SELECT src, dst, round(w, 4) AS w FROM acc WHERE src <> dst ORDER BY w DESC, src, dst LIMIT 25"))
def top_arcs(s, d):
    return out(graph.top_arcs(_acc(s, d), 25), ["src", "dst"], ["w"], 4)


NEAR = "SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS ko, row_number() OVER (PARTITION BY dst ORDER BY w DESC, src) AS ki FROM acc WHERE src <> dst) WHERE ko <= 3 OR ki <= 3"


@query(final(FLUX, f"SELECT src, dst, round(w, 4) AS w FROM ({NEAR})"))
def flow_neighbours(s, d):
    return out(graph.neighbours(_acc(s, d), 3), ["src", "dst"], ["w"], 4)


@query(final(FLUX, f""" ne AS ({NEAR}),
ego AS (SELECT 1 AS node UNION SELECT 2 UNION SELECT 3 UNION SELECT other FROM (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY max(w) DESC, other) AS k FROM (SELECT src AS node, dst AS other, w FROM ne UNION ALL SELECT dst, src, w FROM ne) WHERE node IN (1, 2, 3) GROUP BY node, other) WHERE k <= 3)
SELECT src, dst, round(w, 4) AS w FROM ne WHERE src IN (SELECT node FROM ego) AND dst IN (SELECT node FROM ego)"""))
def flow_subgraph(s, d):
    focus = s.createDataFrame([(1,), (2,), (3,)], "node long")
    return out(graph.subgraph(graph.neighbours(_acc(s, d), 3), focus, 3), ["src", "dst"], ["w"], 4)


@query(final(PI7, """, hub AS (SELECT node FROM pi7 ORDER BY round(pi, 12) DESC, node LIMIT 1),
part AS (SELECT y AS node FROM (SELECT src AS x, dst AS y, w FROM tw UNION ALL SELECT dst, src, w FROM tw) JOIN hub ON x = hub.node WHERE y <> x GROUP BY y ORDER BY sum(w) DESC, y LIMIT 5),
tw AS (SELECT * FROM top),
own AS (SELECT node FROM hub UNION ALL SELECT node FROM part)
SELECT src, dst, round(w, 4) AS w FROM top WHERE src IN (SELECT node FROM own) AND dst IN (SELECT node FROM own)""".replace("tw AS (SELECT * FROM top),\n", "").replace("FROM tw", "FROM top")))
def slice_top6(s, d):
    edges = flux.top_k(_acc(s, d))
    pi = _pi(s, d).withColumn("pi", F.round("pi", 12))
    return out(graph.induced(edges, graph.slice_nodes(pi, edges, 6)), ["src", "dst"], ["w"], 4)


SYM = FLUX + " sym AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM top UNION ALL SELECT dst, src, w FROM top) GROUP BY src, dst), lab AS (SELECT s_suppkey AS node, s_nationkey::BIGINT AS community FROM supplier), cg AS (SELECT a.community AS a, b.community AS b, sum(w) AS w FROM sym JOIN lab a ON a.node = src JOIN lab b ON b.node = dst GROUP BY 1, 2),"


def _sym(s, d):
    return graph.symmetric(flux.top_k(_acc(s, d)))


def _labels(s, d):
    return tables.table(s, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("long").alias("community"))


@query(final(SYM, f"SELECT src, dst, {r('w', 4)} FROM sym"))
def symmetric_graph(s, d):
    return out(_sym(s, d), ["src", "dst"], ["w"], 4)


@query(final(SYM, f"SELECT a, b, {r('w', 3)} FROM cg"))
def community_graph(s, d):
    return out(graph.community_graph(_sym(s, d), _labels(s, d)), ["a", "b"], ["w"], 3)


@query(final(SYM, "SELECT round(sum(own / total - pow(deg / total, 2)), 8) AS modularity FROM (SELECT a, sum(CASE WHEN a = b THEN w ELSE 0 END) AS own, sum(w) AS deg FROM cg GROUP BY a) CROSS JOIN (SELECT sum(w) AS total FROM cg)"))
def modularity(s, d):
    return out(graph.modularity(_sym(s, d), _labels(s, d)), [], ["modularity"], 8)


@query()
def louvain(s, d):
    return graph.louvain(_sym(s, d))


@query(final(FLUX, "SELECT a.node AS src, b.node AS dst, round(a.outflow * b.inflow / (SELECT sum(outflow) FROM mg), 4) AS w FROM mg a JOIN mg b ON a.node <> b.node WHERE a.outflow > 0 AND b.inflow > 0"))
def gravity_null(s, d):
    return out(graph.gravity(_margin(s, d)), ["src", "dst"], ["w"], 4)


@query(final(FLUX, "SELECT src, dst, round(a.outflow * b.inflow / sum(b.inflow) OVER (PARTITION BY src), 4) AS w FROM top JOIN mg a ON a.node = src JOIN mg b ON b.node = dst WHERE a.outflow > 0 AND b.inflow > 0"))
def gravity_support(s, d):
    return out(graph.gravity(_margin(s, d), flux.top_k(_acc(s, d))), ["src", "dst"], ["w"], 4)


TWO = FLUX + " ea AS (SELECT src, dst, sum(w) AS w FROM flux WHERE bar_idx < 40 AND src <> dst GROUP BY src, dst), eb AS (SELECT src, dst, sum(w) AS w FROM flux WHERE bar_idx >= 40 AND src <> dst GROUP BY src, dst),"


def _two(s, d):
    f = _flux(s, d).where("src <> dst")
    return [f.where(c).groupBy("src", "dst").agg(F.sum("w").alias("w")) for c in ("bar_idx < 40", "bar_idx >= 40")]


@query(final(TWO, "SELECT coalesce(ea.src, eb.src) AS src, round(sum(coalesce(ea.w, 0) * coalesce(eb.w, 0)) / sqrt(sum(coalesce(ea.w, 0) * coalesce(ea.w, 0)) * sum(coalesce(eb.w, 0) * coalesce(eb.w, 0))), 7) AS cosine FROM ea FULL JOIN eb ON ea.src = eb.src AND ea.dst = eb.dst GROUP BY 1"))
def row_cosine(s, d):
    return out(graph.row_cosine(*_two(s, d)), ["src"], ["cosine"], 7)


@query(final(TWO, "SELECT (SELECT count(*) FROM (SELECT src, dst FROM (SELECT * FROM ea ORDER BY w DESC, src, dst LIMIT 200) INTERSECT SELECT src, dst FROM (SELECT * FROM eb ORDER BY w DESC, src, dst LIMIT 200))) / least(200, (SELECT count(*) FROM ea), (SELECT count(*) FROM eb))::DOUBLE AS overlap"))
def topk_overlap(s, d):
    return out(graph.top_overlap(*_two(s, d), 200), [], ["overlap"], 8)


@query(final(TWO, """, zz AS (SELECT n * (n - 1) AS t, (SELECT count(*) FROM ea) AS ma, (SELECT count(*) FROM eb) AS mb FROM (SELECT count(*)::DOUBLE AS n FROM nodes)),
ra AS (SELECT src, dst, (SELECT t - ma FROM zz) + rank() OVER (ORDER BY round(w, 6)) + (count(*) OVER (PARTITION BY round(w, 6)) - 1) / 2.0::DOUBLE AS x FROM ea),
rb AS (SELECT src, dst, (SELECT t - mb FROM zz) + rank() OVER (ORDER BY round(w, 6)) + (count(*) OVER (PARTITION BY round(w, 6)) - 1) / 2.0::DOUBLE AS y FROM eb),
al AS (SELECT a.node AS src, b.node AS dst FROM nodes a JOIN nodes b ON a.node <> b.node)
SELECT round(corr(coalesce(x, (t - ma + 1) / 2), coalesce(y, (t - mb + 1) / 2)), 7) AS rho FROM al LEFT JOIN ra USING (src, dst) LEFT JOIN rb USING (src, dst) CROSS JOIN zz"""))
def pair_rank_spearman(s, d):
    a, b = (e.withColumn("w", F.round("w", 6)) for e in _two(s, d))
    return out(stats.sparse_pair_spearman(a, b, _nodes(s, d).agg(F.count("*").alias("n"))), [], ["rho"], 7)


# --- statistics --------------------------------------------------------------------------------------------------
@query(final(BARS, "SELECT bar_idx, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0::DOUBLE) / count(*), 7) AS gini FROM (SELECT bar_idx, v * vw AS x, row_number() OVER (PARTITION BY bar_idx ORDER BY v * vw) AS i FROM bars) GROUP BY bar_idx"))
def gini(s, d):
    return out(stats.gini(_bars(s, d).withColumn("x", F.col("v") * F.col("vw")), "x", ["bar_idx"]), ["bar_idx"], ["gini"], 7)


IC = FWD + """ ic AS (SELECT bar_idx, CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS ic, count(*) AS n FROM (
SELECT bar_idx, rank() OVER (PARTITION BY bar_idx ORDER BY x) + (count(*) OVER (PARTITION BY bar_idx, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY bar_idx ORDER BY fwd) + (count(*) OVER (PARTITION BY bar_idx, fwd) - 1) / 2.0::DOUBLE AS ry
FROM (SELECT fwd.bar_idx, fwd.ticker, r AS x, fwd FROM fwd JOIN rets USING (ticker, bar_idx) WHERE r IS NOT NULL AND fwd IS NOT NULL)) GROUP BY bar_idx),"""


def _ic(s, d):
    bars = _bars(s, d)
    fwd = panel.forward_return(tables.dense(bars), 3).select("ticker", "bar_idx", "fwd")
    return stats.spearman(panel.returns(bars).join(fwd, ["ticker", "bar_idx"]), "r", "fwd", ["bar_idx"])


@query(final(IC, "SELECT bar_idx, n, round(ic, 7) AS ic FROM ic"))
def spearman_ic(s, d):
    return out(_ic(s, d), ["bar_idx", "n"], ["ic"], 7)


@query(final(IC, "SELECT year(t)::BIGINT AS year, count(ic) AS n, round(avg(ic), 7) AS mean, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS t FROM ic JOIN cal USING (bar_idx) GROUP BY year(t)"))
def ic_by_year(s, d):
    cal = _bars(s, d).select("bar_idx", F.year("t").alias("year")).distinct()
    return out(stats.mean_t(_ic(s, d).join(cal, "bar_idx"), "ic", ["year"]).select("year", "n", "mean", F.round("t", 6).alias("t")), ["year", "n"], ["mean", "t"], 7)


@query(final(BARS, "SELECT ticker, bar_idx, round(CASE WHEN s > 0 THEN greatest(-3.0, least(3.0, (r - m) / s)) ELSE 0 END::DOUBLE, 6) AS z FROM (SELECT *, avg(r) OVER (PARTITION BY bar_idx) AS m, stddev_pop(r) OVER (PARTITION BY bar_idx) AS s FROM rets WHERE r IS NOT NULL)"))
def signals_zscore(s, d):
    return out(stats.zscore(_rets(s, d).where("r is not null"), "r", ["bar_idx"]), ["ticker", "bar_idx"], ["z"])


CONT = """WITH c AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*)::DOUBLE AS n FROM customer GROUP BY 1, 2), ma AS (SELECT a, sum(n) AS na FROM c GROUP BY a), mb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c)"""


@query(CONT + """ SELECT round(2 * (SELECT sum(n / t * ln(n * t / (na * nb))) FROM c JOIN ma USING (a) JOIN mb USING (b) CROSS JOIN t) / ((SELECT -sum(na / t * ln(na / t)) FROM ma CROSS JOIN t) + (SELECT -sum(nb / t * ln(nb / t)) FROM mb CROSS JOIN t)), 8) AS nmi""")
def nmi(s, d):
    return out(stats.partition_agreement(tables.table(s, d, "customer"), "c_mktsegment", "c_nationkey"), [], ["nmi"], 8)


@query(CONT + """, q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS i, (SELECT sum(na * (na - 1) / 2) FROM ma) AS x, (SELECT sum(nb * (nb - 1) / 2) FROM mb) AS y, (SELECT t * (t - 1) / 2 FROM t) AS z) SELECT round((i - x * y / z) / ((x + y) / 2 - x * y / z), 8) AS ari FROM q""")
def ari(s, d):
    return out(stats.partition_agreement(tables.table(s, d, "customer"), "c_mktsegment", "c_nationkey"), [], ["ari"], 8)


@query(final(PI7, """SELECT round(1 - corr(rx, ry), 7) AS gain FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM (SELECT round(pi, 12) AS x, round(inflow, 4) AS y FROM pi7 JOIN mg USING (node)))"""))
def structure_gain(s, d):
    rows = _pi(s, d).join(_margin(s, d), "node").select(F.round("pi", 12).alias("x"), F.round("inflow", 4).alias("y"))
    return out(stats.spearman_all(rows, "x", "y").select((1 - F.col("ic")).alias("gain")), [], ["gain"], 7)


@query(final(SYM, "SELECT round(sum(CASE WHEN a.community = b.community THEN w ELSE 0 END) / sum(w), 8) AS coherence FROM top JOIN lab a ON a.node = src JOIN lab b ON b.node = dst"))
def sector_coherence(s, d):
    cg = graph.community_graph(flux.top_k(_acc(s, d)), _labels(s, d))
    return out(cg.agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("coherence")), [], ["coherence"], 8)


@query(final(BARS, "SELECT bar_idx, round(avg(CASE WHEN dec = 10 THEN r END) - avg(CASE WHEN dec = 1 THEN r END), 7) AS spread FROM (SELECT bar_idx, r, ntile(10) OVER (PARTITION BY bar_idx ORDER BY r, ticker) AS dec FROM rets WHERE r IS NOT NULL) GROUP BY bar_idx"))
def decile_spread(s, d):
    dec = F.ntile(10).over(Window.partitionBy("bar_idx").orderBy("r", "ticker"))
    rows = _rets(s, d).where("r is not null").withColumn("dec", dec)
    return out(rows.groupBy("bar_idx").agg((F.avg(F.when(F.col("dec") == 10, F.col("r"))) - F.avg(F.when(F.col("dec") == 1, F.col("r")))).alias("spread")), ["bar_idx"], ["spread"], 7)


@query(final(PI7, """, x AS (SELECT node, pi * 400 AS exact, floor(pi * 400)::BIGINT AS low FROM pi7)
SELECT node, low + CASE WHEN row_number() OVER (ORDER BY round(exact - low, 9) DESC, node) <= (SELECT 400 - sum(low) FROM x) THEN 1 ELSE 0 END AS cells FROM x"""))
def largest_remainder(s, d):
    return out(graph.largest_remainder(_pi(s, d), "pi", 400), ["node", "cells"])


@query(final(BARS, """, g AS (SELECT ticker % 10 AS x, (ticker // 10) % 10 AS y, avg(c) AS z FROM bars GROUP BY 1, 2)
SELECT p.x AS px, p.y AS py, round(sum(q.z / greatest((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), 0.25)) / sum(1 / greatest((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), 0.25)), 5) AS z FROM g p JOIN g q ON abs(p.x - q.x) <= 2 AND abs(p.y - q.y) <= 2 GROUP BY 1, 2"""))
def idw_window(s, d):
    """Inverse-distance surface over a window of two cells around each cell of a lattice."""
    g = _bars(s, d).groupBy((F.col("ticker") % 10).alias("x"), (F.floor(F.col("ticker") / 10) % 10).alias("y")).agg(F.avg("c").alias("z"))
    step = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    near = g.withColumn("dx", step).withColumn("dy", step).select((F.col("x") + F.col("dx")).alias("px"), (F.col("y") + F.col("dy")).alias("py"), "dx", "dy", "z")
    near = near.join(g.select(F.col("x").alias("px"), F.col("y").alias("py")), ["px", "py"])
    w = 1 / F.greatest(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), F.lit(0.25))
    return out(near.groupBy("px", "py").agg((F.sum(F.col("z") * w) / F.sum(w)).alias("z")), ["px", "py"], ["z"], 5)


# --- universe and dimensions -------------------------------------------------------------------------------------
# --- lake --------------------------------------------------------------------------------------------------------
LAKE = "WITH rows AS (SELECT l_suppkey AS ticker, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))::BIGINT AS t, l_extendedprice AS c, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"


def _rows(s, d):
    li = tables.table(s, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("ticker"), F.unix_date(F.to_date("l_shipdate")).cast("long").alias("t"), F.col("l_extendedprice").alias("c"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


@query(LAKE + " SELECT ticker, t, round(c, 4) AS c, seq FROM (SELECT *, row_number() OVER (PARTITION BY ticker, t ORDER BY seq DESC) AS k FROM rows) WHERE k = 1")
def lake_latest_seq(s, d):
    return out(lake.latest(_rows(s, d)), ["ticker", "t", "seq"], ["c"], 4)


@query(LAKE + " SELECT ticker, min(t) AS first_t FROM rows GROUP BY ticker")
def lake_first_times(s, d):
    return lake.first_times(_rows(s, d))


@query(LAKE + " SELECT ticker, min(t) AS covered_from, max(t) AS complete FROM rows GROUP BY ticker")
def coverage_least(s, d):
    r_ = _rows(s, d)
    half = [r_.where(F.pmod("seq", F.lit(2)) == k).groupBy("ticker").agg(F.min("t").alias("covered_from"), F.max("t").alias("complete")) for k in (0, 1)]
    return lake.merge_coverage(*half)


# --- sessions ----------------------------------------------------------------------------------------------------
TICKS = "WITH tk AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS ts, user_id % 20 AS ticker, first(value ORDER BY ts, event_id) AS o, max(value) AS h, min(value) AS l, last(value ORDER BY ts, event_id) AS c, count(*)::DOUBLE AS v, avg(value) AS vw FROM events GROUP BY 1, 2), e AS (SELECT *, ts - INTERVAL 5 HOUR AS et FROM tk),"


def _ticks(s, d):
    ev = tables.table(s, d, "events")
    return sessions.tick_bars(ev.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("ticker"), "value"))


@query(final(TICKS, f"SELECT epoch(ts)::BIGINT AS at, ticker, {r('o, h, l, c, v, vw')} FROM e"))
def tick_bars(s, d):
    return out(_ticks(s, d).withColumn("at", F.unix_timestamp("ts")), ["at", "ticker"], ["o", "h", "l", "c", "v", "vw"])


@query(final(TICKS, "SELECT epoch(ts)::BIGINT AS at, ticker FROM e WHERE isodow(et) <= 5 AND hour(et) * 60 + minute(et) BETWEEN 570 AND 930"))
def session_filter(s, d):
    """Bars within the regular session; the events are of a winter month, five hours off UTC."""
    return out(_ticks(s, d).where(sessions.regular(F.col("ts"), 30)).withColumn("at", F.unix_timestamp("ts")), ["at", "ticker"])


@query(final(TICKS, f"SELECT ticker, CAST(et AS DATE) AS day, least((hour(et) * 60 + minute(et) - 570) // 60, 6)::BIGINT AS bucket, round(first(o ORDER BY ts), 6) AS o, round(max(h), 6) AS h, round(min(l), 6) AS l, round(last(c ORDER BY ts), 6) AS c, round(sum(v), 6) AS v, round(sum(v * vw) / sum(v), 6) AS vw FROM e WHERE isodow(et) <= 5 AND hour(et) * 60 + minute(et) BETWEEN 570 AND 930 GROUP BY 1, 2, 3"))
def session_hours(s, d):
    bars = _ticks(s, d).where(sessions.regular(F.col("ts"), 30))
    return out(sessions.session_hours(bars), ["ticker", "day", "bucket"], ["o", "h", "l", "c", "v", "vw"])


SESS = TICKS + " g AS (SELECT * FROM e WHERE isodow(et) <= 5 AND hour(et) * 60 + minute(et) BETWEEN 570 AND 930), ct AS (SELECT ts, dense_rank() OVER (ORDER BY CAST(et AS DATE)) - 1 AS session, row_number() OVER (PARTITION BY CAST(et AS DATE) ORDER BY ts) - 1 AS slot FROM (SELECT DISTINCT ts, et FROM g)),"


def _session_bars(s, d):
    bars = _ticks(s, d).where(sessions.regular(F.col("ts"), 30))
    return bars.join(sessions.session_index(bars), "ts")


@query(final(SESS, "SELECT epoch(ts)::BIGINT AS at, session, slot, slot = 0 AS is_first, slot = max(slot) OVER (PARTITION BY session) AS is_last FROM ct"))
def session_index(s, d):
    bars = _ticks(s, d).where(sessions.regular(F.col("ts"), 30))
    return out(sessions.session_index(bars).withColumn("at", F.unix_timestamp("ts")), ["at", "session", "slot", "is_first", "is_last"])


@query(final(SESS, "SELECT epoch(ts)::BIGINT AS at, ticker, round(CASE WHEN lead(session, 1) OVER w = lead(session, 3) OVER w THEN lead(o, 3) OVER w / lead(o, 1) OVER w - 1 END::DOUBLE, 6) AS label FROM g JOIN ct USING (ts) WINDOW w AS (PARTITION BY ticker ORDER BY ts)"))
def label_session_masked(s, d):
    return out(sessions.session_label(_session_bars(s, d), 2).withColumn("at", F.unix_timestamp("ts")), ["at", "ticker"], ["label"])


@query(final(SESS, "SELECT epoch(ts)::BIGINT AS at, ticker, round(v / quantile_cont(v, 0.5) OVER (PARTITION BY ticker, slot ORDER BY session RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS shock FROM g JOIN ct USING (ts)"))
def dvshock_slot(s, d):
    return out(sessions.slot_shock(_session_bars(s, d)).withColumn("at", F.unix_timestamp("ts")), ["at", "ticker"], ["shock"])


@query("WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), b AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) SELECT a.event_id, round(b.value, 6) AS value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_prior(s, d):
    ev = tables.table(s, d, "events")
    left = ev.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return out(sessions.as_of(left, right, ["user_id"], "ts", "value"), ["event_id"], ["value"])


# --- holdings ----------------------------------------------------------------------------------------------------
HOLD = "WITH hold AS (SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, o_custkey AS cik, p_brand AS ticker, sum(l_quantity) AS shares, sum(l_extendedprice) AS value_usd FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),"


@query(final(HOLD, """ px AS (SELECT ticker, sum(value_usd) / sum(shares) AS price FROM hold WHERE quarter IN ('1996Q1', '1996Q2') GROUP BY ticker),
d AS (SELECT cik, ticker, sum(CASE WHEN quarter = '1996Q2' THEN shares ELSE -shares END) * any_value(price) AS d FROM hold JOIN px USING (ticker) WHERE quarter IN ('1996Q1', '1996Q2') GROUP BY cik, ticker),
m AS (SELECT cik, sum(greatest(-d, 0)) AS so, sum(greatest(d, 0)) AS si FROM d GROUP BY cik HAVING so > 0 AND si > 0)
SELECT a.ticker AS src, b.ticker AS dst, round(sum(-a.d * b.d * least(so, si) / (so * si)), 3) AS w FROM d a JOIN d b USING (cik) JOIN m USING (cik) WHERE a.d < 0 AND b.d > 0 GROUP BY 1, 2"""))
def observed_flows(s, d):
    return out(holdings.observed_flows(tables.holdings(s, d), "1996Q1", "1996Q2"), ["src", "dst"], ["w"], 3)


@query(final(HOLD, "SELECT quarter, ticker, count(*) AS holders, round(quantile_cont(value_usd / shares, 0.5), 8) AS price FROM hold WHERE shares > 0 GROUP BY quarter, ticker"))
def quarter_pricing(s, d):
    return out(holdings.quarter_pricing(tables.holdings(s, d)), ["quarter", "ticker", "holders"], ["price"], 8)


FILED = "WITH f AS (SELECT o_custkey AS cik, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, o_orderdate AS filed, o_orderkey AS accession, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'original' WHEN '2' THEN 'restatement' WHEN '3' THEN 'new holdings' ELSE 'original' END AS kind FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY cik, period ORDER BY filed, accession) AS n FROM f), b AS (SELECT cik, period, max(n) AS base FROM n WHERE kind <> 'new holdings' GROUP BY 1, 2)"


@query(FILED + " SELECT accession, kind FROM n JOIN b USING (cik, period) WHERE n = base OR (n > base AND kind = 'new holdings')")
def amendment_base(s, d):
    o = tables.table(s, d, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    kind = F.when(first == "2", "restatement").when(first == "3", "new holdings").otherwise("original")
    f = o.select(F.col("o_custkey").alias("cik"), F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("period"), F.col("o_orderdate").alias("filed"), F.col("o_orderkey").alias("accession"), kind.alias("kind"))
    return holdings.amendment_base(f).select("accession", "kind")


@query(final(HOLD, "SELECT quarter, round(sum(CASE WHEN ticker < 'Brand#30' THEN value_usd ELSE 0 END) / sum(value_usd), 8) AS share FROM hold GROUP BY quarter"))
def mapped_coverage(s, d):
    h = tables.holdings(s, d)
    return out(holdings.coverage(h, h.where("ticker < 'Brand#30'").select("ticker")), ["quarter"], ["share"], 8)


# --- walk-forward ------------------------------------------------------------------------------------------------
SIG = FWD + """ sg AS (SELECT fwd.bar_idx, fwd.ticker, fwd, r AS mom, -ln(rets.v * rets.vw) AS small FROM fwd JOIN rets USING (ticker, bar_idx) WHERE fwd IS NOT NULL AND r IS NOT NULL),
lg AS (SELECT bar_idx, ticker, fwd, 'mom' AS signal, mom AS x FROM sg UNION ALL SELECT bar_idx, ticker, fwd, 'small', small FROM sg),
sic AS (SELECT bar_idx AS step, signal, corr(rx, ry) AS ic FROM (SELECT bar_idx, signal, rank() OVER (PARTITION BY bar_idx, signal ORDER BY x) + (count(*) OVER (PARTITION BY bar_idx, signal, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY bar_idx, signal ORDER BY fwd) + (count(*) OVER (PARTITION BY bar_idx, signal, fwd) - 1) / 2.0::DOUBLE AS ry FROM lg) GROUP BY 1, 2),
bw AS (SELECT step, signal, coalesce(pos / nullif(sum(pos) OVER (PARTITION BY step), 0), 0) AS w FROM (SELECT step, signal, CASE WHEN count(ic) OVER w >= 6 THEN greatest(avg(ic) OVER w, 0) ELSE 0 END AS pos FROM sic WINDOW w AS (PARTITION BY signal ORDER BY step ROWS BETWEEN 37 PRECEDING AND 2 PRECEDING))),"""


def _signals(s, d):
    bars = _bars(s, d)
    fwd = panel.forward_return(tables.dense(bars), 3).select("ticker", "bar_idx", "fwd")
    rows = panel.returns(bars).join(fwd, ["ticker", "bar_idx"]).where("fwd is not null and r is not null")
    pair = F.explode(F.array(F.struct(F.lit("mom").alias("signal"), F.col("r").alias("x")), F.struct(F.lit("small").alias("signal"), (-F.ln(F.col("v") * F.col("vw"))).alias("x"))))
    return rows.select("bar_idx", "ticker", "fwd", pair.alias("y")).select("bar_idx", "ticker", "fwd", "y.signal", "y.x")


def _blend(s, d):
    ic = stats.spearman(_signals(s, d), "x", "fwd", ["bar_idx", "signal"]).withColumnRenamed("bar_idx", "step")
    return walkforward.blend_weights(ic, 36, 1)


@query(final(SIG, "SELECT step, signal, round(w::DOUBLE, 6) AS w FROM bw"))
def blend_weights(s, d):
    return out(_blend(s, d), ["step", "signal"], ["w"])


@query(final(SIG, """ sc AS (SELECT bar_idx AS step, ticker, x AS score FROM lg WHERE signal = 'mom' AND bar_idx % 6 = 0), bm AS (SELECT node AS ticker, 1.0::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT ticker AS node FROM b0)) AS w FROM (SELECT DISTINCT ticker AS node FROM b0))
SELECT step, ticker, round(sum(w), 8) AS w FROM (SELECT step, ticker, 0.8::DOUBLE * w AS w FROM (SELECT DISTINCT step FROM sc) CROSS JOIN bm UNION ALL SELECT step, ticker, 0.02::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY score DESC, ticker) AS k FROM sc) WHERE k <= 10) GROUP BY 1, 2"""))
def target_weights(s, d):
    return out(_targets(s, d), ["step", "ticker"], ["w"], 8)


def _targets(s, d):
    scores = _signals(s, d).where("signal = 'mom' and bar_idx % 6 = 0").select(F.col("bar_idx").alias("step"), "ticker", F.col("x").alias("score"))
    nodes = _nodes(s, d).withColumnRenamed("node", "ticker")
    base = nodes.crossJoin(nodes.agg((1 / F.count("*")).alias("w")))
    return walkforward.target_weights(scores, base)


CURVE = BARS + " cv AS (SELECT CASE WHEN ticker % 2 = 0 THEN 'even' ELSE 'odd' END AS strategy, bar_idx AS t, avg(c) AS value FROM bars GROUP BY 1, 2), cr AS (SELECT *, value / lag(value) OVER (PARTITION BY strategy ORDER BY t) - 1 AS r, value / max(value) OVER (PARTITION BY strategy ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM cv),"


def _curves(s, d):
    return _bars(s, d).groupBy(F.when(F.col("ticker") % 2 == 0, "even").otherwise("odd").alias("strategy"), F.col("bar_idx").alias("t")).agg(F.avg("c").alias("value"))


@query(final(CURVE, "SELECT strategy, count(r) AS n, round(last(value ORDER BY t) / first(value ORDER BY t) - 1, 7) AS cum, round(pow(last(value ORDER BY t) / first(value ORDER BY t), 12.0::DOUBLE / count(r)) - 1, 7) AS ann, round(stddev_samp(r) * sqrt(12.0::DOUBLE), 7) AS vol, round(avg(r) * sqrt(12.0::DOUBLE) / stddev_samp(r), 7) AS sharpe, round(min(dd), 7) AS drawdown, round(kurtosis_pop(r) + 3, 6) AS kurt FROM cr GROUP BY strategy"))
def perf_metrics(s, d):
    p = walkforward.performance(_curves(s, d), 12)
    return out(p.withColumn("kurt", F.round("kurt", 6)), ["strategy", "n"], ["cum", "ann", "vol", "sharpe", "drawdown", "kurt"], 7)


@query(final(CURVE, "SELECT strategy, t, round(dd, 7) AS drawdown FROM cr"))
def drawdown(s, d):
    w = Window.partitionBy("strategy").orderBy("t")
    return out(_curves(s, d).withColumn("drawdown", F.col("value") / F.max("value").over(w) - 1), ["strategy", "t"], ["drawdown"], 7)


@query(final(CURVE, "SELECT a.strategy, round(avg(a.r - b.r) / stddev_samp(a.r - b.r), 7) AS ir FROM cr a JOIN cr b ON a.t = b.t AND b.strategy = 'odd' WHERE a.strategy = 'even' AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY a.strategy"))
def information_ratio(s, d):
    c = _curves(s, d)
    return out(walkforward.information_ratio(c.where("strategy = 'even'"), c.where("strategy = 'odd'")), ["strategy"], ["ir"], 7)


@query(final(BARS, "SELECT year(t)::BIGINT AS year, count(r) AS n, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS hit FROM rets JOIN cal USING (t, bar_idx) WHERE r IS NOT NULL GROUP BY 1"))
def year_hit_rate(s, d):
    rows = _rets(s, d).where("r is not null").groupBy(F.year("t").alias("year")).agg(F.count("r").alias("n"), F.avg((F.col("r") > 0).cast("double")).alias("hit"))
    return out(rows, ["year", "n"], ["hit"], 8)


@query(final(BARS, "SELECT ticker, count(r) AS n, round(var_samp(r), 8) AS var FROM rets WHERE r IS NOT NULL GROUP BY ticker"))
def registry_variance(s, d):
    return out(_rets(s, d).where("r is not null").groupBy("ticker").agg(F.count("r").alias("n"), F.var_samp("r").alias("var")), ["ticker", "n"], ["var"], 8)


@query(final(IC, "SELECT round(avg(m), 7) AS mean, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 6) AS t FROM (SELECT avg(ic) AS m FROM ic JOIN cal USING (bar_idx) WHERE ic IS NOT NULL GROUP BY date_trunc('quarter', t))"))
def clustered_t(s, d):
    cal = _bars(s, d).select("bar_idx", F.date_trunc("quarter", "t").alias("q")).distinct()
    m = _ic(s, d).where("ic is not null").join(cal, "bar_idx").groupBy("q").agg(F.avg("ic").alias("m")).withColumn("all", F.lit(0))
    return out(stats.mean_t(m, "m", ["all"]).select("mean", F.round("t", 6).alias("t")), [], ["mean", "t"], 7)
