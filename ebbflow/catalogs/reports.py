"""Queries of what runs leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import BARS, CURVE, FLUX, _acc, _bars, _curves, final, out, query
from ..operators import flux
from ..sources import reports, tables
from .frames import ACT, PRESET

PANEL = ACT + """ ft AS (SELECT ticker, bar_idx, CASE WHEN n1 >= 10 THEN cv / m END AS dvshock, CASE WHEN cv > 0 THEN ln(cv) END AS ldv, ret1, CASE WHEN count(ret1) OVER w >= 10 THEN stddev_samp(ret1) OVER w END AS vol20 FROM (
SELECT ticker, bar_idx, c * v AS cv, CASE WHEN bar_idx - lag(bar_idx) OVER o = 1 THEN ln(c / lag(c) OVER o) END AS ret1, quantile_cont(c * v, 0.5) OVER b AS m, count(c * v) OVER b AS n1 FROM bars
WINDOW o AS (PARTITION BY ticker ORDER BY bar_idx), b AS (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WINDOW w AS (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
eg AS (SELECT ticker, bar_idx, n >= 10 AND med >= 100000 AS elig FROM (SELECT ticker, bar_idx, quantile_cont(v * vw, 0.5) OVER w AS med, count(v * vw) OVER w AS n FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))),
lb AS (SELECT ticker, bar_idx, CASE WHEN lead(o, 1) OVER w > 0 THEN lead(o, 4) OVER w / lead(o, 1) OVER w - 1 END AS label FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY bar_idx)),"""


@query(final(PANEL, " SELECT ticker, bar_idx::BIGINT AS bar_idx, round(ret1, 6) AS ret1, round(ldv, 6) AS ldv, round(dvshock, 6) AS dvshock, round(vol20, 6) AS vol20, round(CASE WHEN active THEN coalesce(p, 0) ELSE 0 END, 3) AS pressure, active, coalesce(elig, false) AS elig, round(label, 6) AS label FROM act LEFT JOIN p USING (ticker, bar_idx) LEFT JOIN ft USING (ticker, bar_idx) LEFT JOIN eg USING (ticker, bar_idx) LEFT JOIN lb USING (ticker, bar_idx)"))
def feature_panel(s, d):
    """The panel that is exported for learning."""
    rows = reports.feature_panel(_bars(s, d), PRESET, 3, 20, 100_000.0).withColumn("pressure", F.round("pressure", 3))
    return out(rows, ["ticker", "bar_idx", "active", "elig"], ["ret1", "ldv", "dvshock", "vol20", "pressure", "label"])


@query(final(CURVE, "SELECT t::BIGINT AS t, round(max(CASE WHEN strategy = 'even' THEN value END), 7) AS even, round(max(CASE WHEN strategy = 'odd' THEN value END), 7) AS odd FROM cv GROUP BY t"))
def equity_wide(s, d):
    return out(reports.wide(_curves(s, d), ["even", "odd"]), ["t"], ["even", "odd"], 7)


@query(final(FLUX, "SELECT src, dst, round(w, 4) AS w, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank FROM top)"))
def graph_rows(s, d):
    return out(reports.graph_rows(flux.top_k(_acc(s, d))), ["src", "dst", "rank"], ["w"], 4)


@query(final(BARS, "SELECT ((st - 30) // 12)::BIGINT AS block, (st - 2)::BIGINT AS train_end, st::BIGINT AS start, least(st + 12, (SELECT max(bar_idx) + 1 FROM cal))::BIGINT AS \"end\" FROM range(30, (SELECT max(bar_idx) + 1 FROM cal), 12) r(st)"))
def retrain_blocks(s, d):
    return reports.retrain_blocks(_bars(s, d).select("bar_idx").distinct(), 30, 12, 2)


@query("WITH p AS (SELECT o_custkey AS ticker, year(o_orderdate)::BIGINT AS t, o_orderkey AS cutoff, o_totalprice AS score FROM orders) SELECT ticker, t, round(arg_max(score, cutoff), 4) AS score FROM p GROUP BY ticker, t")
def newest_predictions(s, d):
    o = tables.table(s, d, "orders")
    return out(reports.predictions(o.select(F.col("o_custkey").alias("ticker"), F.year("o_orderdate").cast("long").alias("t"), F.col("o_orderkey").alias("cutoff"), F.col("o_totalprice").alias("score"))), ["ticker", "t"], ["score"], 4)


@query("WITH p AS (SELECT o_custkey % 50 AS src, o_orderkey AS dst, o_totalprice AS w, year(o_orderdate)::BIGINT AS cutoff FROM orders) SELECT src, dst, round(w, 4) AS w, cutoff FROM p WHERE cutoff = (SELECT max(cutoff) FROM p WHERE cutoff <= 1995)")
def latest_graph(s, d):
    o = tables.table(s, d, "orders")
    g = o.select((F.col("o_custkey") % 50).alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_totalprice").alias("w"), F.year("o_orderdate").cast("long").alias("cutoff"))
    return out(reports.latest_store(g, 1995), ["src", "dst", "cutoff"], ["w"], 4)


@query(final(PANEL, " SELECT bar_idx::BIGINT AS bar_idx, ticker, place FROM (SELECT bar_idx, ticker, row_number() OVER (PARTITION BY bar_idx ORDER BY round(ldv, 9) DESC, ticker) AS place FROM act JOIN ft USING (ticker, bar_idx) JOIN eg USING (ticker, bar_idx) JOIN lb USING (ticker, bar_idx) WHERE active AND elig AND label IS NOT NULL) WHERE place <= 20"))
def node_set(s, d):
    """The nodes that a learner sees on each bar."""
    f = reports.feature_panel(_bars(s, d), PRESET, 3, 20, 100_000.0).withColumn("ldv", F.round("ldv", 9))
    return out(reports.node_set(f, 20), ["bar_idx", "ticker", "place"])
