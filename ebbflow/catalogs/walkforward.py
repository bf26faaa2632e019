"""Queries of the walk-forward study: simulation, performance, gate, blend and information coefficients."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import BARS, CURVE, FWD, IC, SIG, _bars, _blend, _curves, _ic, _rets, _signals, _targets, final, out, query, r
from ..operators import panel, stats
from ..operators import walkforward as wf
from ..sources import tables

TARGETS = """ sc AS (SELECT bar_idx AS step, ticker, x AS score FROM lg WHERE signal = 'mom' AND bar_idx % 6 = 0), nd AS (SELECT DISTINCT ticker FROM b0),
tw AS (SELECT step, ticker, sum(w) AS w FROM (SELECT step, ticker, 0.8::DOUBLE / (SELECT count(*) FROM nd) AS w FROM (SELECT DISTINCT step FROM sc) CROSS JOIN nd UNION ALL SELECT step, ticker, 0.02::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY score DESC, ticker) AS k FROM sc) WHERE k <= 10) GROUP BY 1, 2),"""
#: The book as lists over the tickers, one bar after the other: the definition as a recursion.
SIMULATE = SIG.replace("WITH ", "WITH RECURSIVE ", 1) + TARGETS + """
px AS (SELECT bar_idx AS t, list(o ORDER BY ticker) AS o, list(c ORDER BY ticker) AS c FROM grid GROUP BY bar_idx),
tl AS (SELECT step + 1 AS t, list(coalesce(w, 0) ORDER BY nd.ticker) AS w FROM (SELECT DISTINCT step FROM tw) CROSS JOIN nd LEFT JOIN tw USING (step, ticker) GROUP BY step),
sim AS (SELECT -1::BIGINT AS t, 1.0::DOUBLE AS cash, (SELECT list(0.0::DOUBLE) FROM nd) AS sh, (SELECT list(NULL::DOUBLE) FROM nd) AS last, 0::INT AS began, 1.0::DOUBLE AS value, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS turnover
UNION ALL
SELECT t, cash3, sh3, list_transform(list_zip(c, last1), lambda x: coalesce(x[1], x[2])), greatest(began, CASE WHEN w IS NULL THEN 0 ELSE 1 END),
  cash3 + list_sum(list_transform(list_zip(sh3, c, last1), lambda x: CASE WHEN x[1] <> 0 THEN x[1] * coalesce(x[2], x[3]) ELSE 0.0::DOUBLE END)), coalesce(cost, 0), CASE WHEN began = 1 AND w IS NOT NULL THEN gross / (2 * v) ELSE 0 END
FROM (SELECT *, CASE WHEN w IS NULL THEN cash ELSE (cash - net) * f END AS cash3, CASE WHEN w IS NULL THEN sh ELSE list_transform(list_zip(sh, o, d2), lambda x: CASE WHEN x[2] IS NULL THEN x[1] ELSE (x[1] * x[2] + x[3]) * f / x[2] END) END AS sh3 FROM (
SELECT *, CASE WHEN w IS NULL THEN 1 ELSE (cash - net + worth - cost) / (cash - net + worth) END AS f FROM (
SELECT *, 0.001::DOUBLE * gross AS cost, list_sum(list_transform(list_zip(sh, o, d2), lambda x: CASE WHEN x[2] IS NULL THEN 0.0::DOUBLE ELSE x[1] * x[2] + x[3] END)) AS worth FROM (
SELECT *, list_sum(list_transform(d2, lambda x: abs(x))) AS gross, list_sum(d2) AS net FROM (
SELECT *, list_transform(d1, lambda x: CASE WHEN x > 0 AND buys > cash + sells THEN x * greatest(0, cash + sells) / buys ELSE x END) AS d2 FROM (
SELECT *, list_sum(list_transform(d1, lambda x: greatest(x, 0))) AS buys, list_sum(list_transform(d1, lambda x: greatest(-x, 0))) AS sells FROM (
SELECT *, list_transform(d0, lambda x: CASE WHEN began = 1 AND turn > 0.5 THEN x * 0.5::DOUBLE / turn ELSE x END) AS d1 FROM (
SELECT *, list_sum(list_transform(d0, lambda x: abs(x))) / (2 * v) AS turn FROM (
SELECT *, list_transform(list_zip(w, sh, o), lambda x: CASE WHEN x[3] IS NULL THEN 0.0::DOUBLE ELSE x[1] * v - x[2] * x[3] END) AS d0 FROM (
SELECT px.t, cash, sh, began, o, c, w, last1, cash + list_sum(list_transform(list_zip(sh, last1), lambda x: CASE WHEN x[1] <> 0 THEN x[1] * x[2] ELSE 0.0::DOUBLE END)) AS v FROM (
SELECT px.t, cash, sh, began, o, c, list_transform(list_zip(o, last), lambda x: coalesce(x[1], x[2])) AS last1 FROM sim JOIN px ON px.t = sim.t + 1) px LEFT JOIN tl ON tl.t = px.t)))))))))))"""


@query(final(SIMULATE, " SELECT 'tilt' AS strategy, t::BIGINT AS t, round(value, 6) AS value, round(cost, 7) AS cost, round(turnover, 6) AS turnover FROM sim WHERE began = 1"))
def simulate(s, d):
    """Value curve of the tilted portfolio; sequential by definition, so one group for each strategy."""
    t = _targets(s, d).select(F.lit("tilt").alias("strategy"), F.col("step").alias("t"), "ticker", "w")
    prices = tables.dense(_bars(s, d)).select(F.col("bar_idx").alias("t"), "ticker", "o", "c")
    rows = wf.simulate(prices, t).withColumn("cost", F.round("cost", 7))
    return out(rows.withColumns({"value": F.round("value", 6), "turnover": F.round("turnover", 6)}), ["strategy", "t"], ["value", "cost", "turnover"], 7)


@query(final(BARS, """ ds AS (SELECT bar_idx AS t FROM cal WHERE bar_idx % 12 = 0 AND bar_idx > 0), bs AS (SELECT DISTINCT ticker FROM b0 WHERE ticker <= 4), el AS (SELECT bar_idx AS t, ticker FROM bars WHERE v * vw >= 1000000)
SELECT 'buyhold' AS strategy, (SELECT min(t) FROM ds)::BIGINT AS t, ticker, 0.25::DOUBLE AS w FROM bs UNION ALL SELECT 'rebalanced', t, ticker, 0.25::DOUBLE FROM ds CROSS JOIN bs UNION ALL SELECT 'single', (SELECT min(t) FROM ds), 7, 1.0::DOUBLE
UNION ALL SELECT 'ew_eligible', t, ticker, round(1.0::DOUBLE / count(*) OVER (PARTITION BY t), 9) FROM el JOIN ds USING (t)"""))
def benchmark_targets(s, d):
    bars = _bars(s, d)
    ds = bars.where("bar_idx % 12 = 0 and bar_idx > 0").select(F.col("bar_idx").alias("t")).distinct()
    base = bars.where("ticker <= 4").select("ticker").distinct().withColumn("w", F.lit(0.25))
    return out(wf.benchmarks(ds, base, bars.where("v * vw >= 1000000").select(F.col("bar_idx").alias("t"), "ticker"), 7), ["strategy", "t", "ticker"], ["w"], 9)


AGAINST = CURVE + """ c1 AS (SELECT strategy, t, value / coalesce(lag(value) OVER (PARTITION BY strategy ORDER BY t), 1.0::DOUBLE) - 1 AS r FROM cv),
ag AS (SELECT a.strategy, a.t, a.r, a.r - b.r AS e, year(cal.t) AS y FROM c1 a JOIN c1 b ON b.t = a.t AND b.strategy = 'odd' JOIN cal ON cal.bar_idx = a.t),
lv AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY t)) AS level FROM ag),
fa AS (SELECT *, 1 - level / greatest(1, max(level) OVER (PARTITION BY strategy ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS fall FROM lv),
mm AS (SELECT strategy, avg(r) AS mr, avg(e) AS me FROM ag GROUP BY strategy),
yy AS (SELECT strategy, count(*) AS years, avg(CASE WHEN s > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit FROM (SELECT strategy, y, sum(e) AS s FROM ag GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY strategy),"""


def _against(s, d):
    days = _bars(s, d).select(F.col("bar_idx").alias("t"), F.col("t").alias("day")).distinct()
    return wf.against(_curves(s, d).join(days, "t"), "odd", 12, 10)


@query(final(AGAINST, """ SELECT strategy, count(*) AS "T", round(max_by(level, t) - 1, 6) AS cum, round(pow(max_by(level, t), 12.0::DOUBLE / count(*)) - 1, 6) AS ann, round(stddev_samp(r) * sqrt(12.0::DOUBLE), 6) AS vol, round(avg(r) / stddev_samp(r), 6) AS sharpe_period, round(avg(e) * 12, 6) AS ann_excess, round(CASE WHEN stddev_samp(e) > 1e-12 THEN avg(e) / stddev_samp(e) END, 6) AS ir_period, round(max(fall), 6) AS drawdown,
round(avg(pow(r - mr, 3)) / pow(avg(pow(r - mr, 2)), 1.5), 5) AS skew, round(avg(pow(r - mr, 4)) / pow(avg(pow(r - mr, 2)), 2), 5) AS kurt, any_value(years) AS years, round(any_value(hit), 6) AS year_hit_rate FROM fa JOIN mm USING (strategy) JOIN yy USING (strategy) GROUP BY strategy"""))
def performance_against(s, d):
    p = _against(s, d).withColumns({"skew": F.round("skew", 5), "kurt": F.round("kurt", 5)})
    return out(p, ["strategy", "T", "years"], ["cum", "ann", "vol", "sharpe_period", "ann_excess", "ir_period", "drawdown", "skew", "kurt", "year_hit_rate"], 6)


BOOT = AGAINST + """ ev AS (SELECT e, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM ag WHERE strategy = 'even'),
dr AS (SELECT rep, b, ('0x' || substr(md5('11:' || rep || ':' || b), 1, 8))::BIGINT % (SELECT max(n) FROM ev) AS s FROM range(200) r(rep), range((SELECT ceil(max(n) / 6.0)::BIGINT FROM ev)) q(b)),
sm AS (SELECT rep, sum(e) / max(n) AS m FROM dr JOIN range(6) k(k) ON b * 6 + k < (SELECT max(n) FROM ev) JOIN ev ON i = (s + k) % n GROUP BY rep),
bo AS (SELECT (SELECT m FROM sm ORDER BY m LIMIT 1 OFFSET 4) AS lo, (SELECT m FROM sm ORDER BY m LIMIT 1 OFFSET 194) AS hi),"""


def _boot(s, d):
    c = _curves(s, d)
    from pyspark.sql import Window

    w = Window.partitionBy("strategy").orderBy("t")
    rr = c.withColumn("r", F.col("value") / F.coalesce(F.lag("value").over(w), F.lit(1.0)) - 1)
    e = rr.where("strategy = 'even'").join(rr.where("strategy = 'odd'").select("t", F.col("r").alias("rb")), "t").select("strategy", "t", (F.col("r") - F.col("rb")).alias("e"))
    return wf.bootstrap_mean(e, "e", ["strategy"], "t", 6, 200, 11)


@query(final(BOOT, " SELECT 'even' AS strategy, round(lo, 7) AS lo, round(hi, 7) AS hi FROM bo"))
def bootstrap_interval(s, d):
    return out(_boot(s, d), ["strategy"], ["lo", "hi"], 7)


@query(final(BARS, f" SELECT ticker, bar_idx::BIGINT AS bar_idx, round(coalesce((SELECT 0.5::DOUBLE + exp(-z * z / 2) / sqrt(2 * pi()) * (z + list_sum(list_transform(range(1, 100), lambda k: z * list_product(list_transform(range(1, k + 1), lambda j: z * z / (2 * j + 1))))))), 0), 7) AS p FROM (SELECT ticker, bar_idx, greatest(-6, least(6, r * 10)) AS z FROM rets WHERE r IS NOT NULL AND ticker % 5 = 0)"))
def norm_cdf_of_returns(s, d):
    """The normal distribution of scaled returns, against its series."""
    z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), F.col("r") * 10))
    return out(_rets(s, d).where("r is not null and ticker % 5 = 0").withColumn("p", stats.norm_cdf(z)), ["ticker", "bar_idx"], ["p"], 7)


GATE = BOOT + """ pf AS (SELECT strategy, avg(e) * 12 AS ann_excess, avg(e) / stddev_samp(e) AS ir, max(fall) AS drawdown, any_value(hit) AS hit, count(*) AS n, avg(pow(e - me, 3)) / pow(avg(pow(e - me, 2)), 1.5) AS sk, avg(pow(e - me, 4)) / pow(avg(pow(e - me, 2)), 2) AS ku FROM fa JOIN mm USING (strategy) JOIN yy USING (strategy) WHERE strategy = 'even' GROUP BY strategy),
dz AS (SELECT *, ir * sqrt(n - 1) / sqrt(1 - sk * ir + (ku - 1) / 4 * ir * ir) AS z FROM pf),
dd AS (SELECT *, 0.5::DOUBLE + exp(-z * z / 2) / sqrt(2 * pi()) * (z + list_sum(list_transform(range(1, 100), lambda k: z * list_product(list_transform(range(1, k + 1), lambda j: z * z / (2 * j + 1)))))) AS dsr FROM dz),
gt AS (SELECT strategy, dsr, ann_excess > 0 AND (SELECT lo FROM bo) * 12 > 0 AS c1, hit >= 0.6 AS c2, dsr > 0.95 AS c3, drawdown <= (SELECT max(fall) FROM fa WHERE strategy = 'odd') + 0.05 AS c4, true AS c5 FROM dd),"""


def _gated(s, d):
    perf = _against(s, d)
    base = perf.where("strategy = 'odd'").select("drawdown").first()[0]
    rows = perf.where("strategy = 'even'").join(_boot(s, d).select("strategy", F.col("lo").alias("ci_lo")), "strategy")
    rows = rows.withColumn("dsr", wf.deflated_sharpe(F.col("ir_period"), F.col("T"), F.col("skew_e"), F.col("kurt_e"), F.lit(0.0), F.lit(1.0)))
    return rows, base


@query(final(GATE, " SELECT strategy, round(dsr, 6) AS dsr, c1, c2, c3, c4, c5, c1 AND c2 AND c3 AND c4 AND c5 AS passed, concat_ws('; ', CASE WHEN NOT c1 THEN 'c1' END, CASE WHEN NOT c2 THEN 'c2' END, CASE WHEN NOT c3 THEN 'c3' END, CASE WHEN NOT c4 THEN 'c4' END, CASE WHEN NOT c5 THEN 'c5' END) AS reason FROM gt"))
def decision_gate(s, d):
    rows, base = _gated(s, d)
    gate = wf.decision_gate(rows, base, 12)
    return gate.join(rows.select("strategy", F.round("dsr", 6).alias("dsr")), "strategy").select("strategy", "dsr", "c1", "c2", "c3", "c4", "c5", "passed", "reason")


@query(final(CURVE, """ ds AS (SELECT bar_idx AS t, lead(bar_idx) OVER (ORDER BY bar_idx) AS nx FROM cal WHERE bar_idx % 6 = 5), f0 AS (SELECT strategy, min(t) AS first FROM cv GROUP BY strategy),
pr AS (SELECT strategy, ds.t, b.value / CASE WHEN first > ds.t AND first <= nx THEN 1.0::DOUBLE ELSE a.value END - 1 AS r FROM f0 CROSS JOIN ds LEFT JOIN cv a USING (strategy, t) LEFT JOIN (SELECT strategy, t AS nx, value FROM cv) b USING (strategy, nx)),
df AS (SELECT x.t, year(cal.t) AS y, x.r - z.r AS d FROM pr x JOIN pr z ON z.t = x.t AND z.strategy = 'odd' JOIN cal ON cal.bar_idx = x.t WHERE x.strategy = 'even' AND x.r IS NOT NULL AND z.r IS NOT NULL)
SELECT count(*) AS n, round(avg(d), 7) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, (SELECT count(*) FROM (SELECT y FROM df GROUP BY y HAVING avg(d) > 0)) AS years_pos, (SELECT count(DISTINCT y) FROM df) AS years FROM df"""))
def paired_diff(s, d):
    bars, c = _bars(s, d), _curves(s, d)
    dates = bars.where("bar_idx % 6 = 5").select(F.col("bar_idx").alias("t"))
    p = wf.period_returns(c, dates)
    years = bars.select(F.col("bar_idx").alias("t"), F.year("t").alias("year")).distinct()
    rows = wf.paired_diff(p.where("strategy = 'even'"), p.where("strategy = 'odd'"), years)
    return out(rows.withColumn("t", F.round("t", 6)), ["n", "years_pos", "years"], ["mean", "t"], 7)


@query(final(CURVE, "SELECT strategy, t::BIGINT AS t, round(value / (SELECT value FROM cv b WHERE b.strategy = cv.strategy AND b.t = 11), 7) AS value FROM cv WHERE t BETWEEN 12 AND 40"))
def curve_span(s, d):
    return out(wf.span_of(_curves(s, d), 12, 40), ["strategy", "t"], ["value"], 7)


BLEND = SIG + """ zl AS (SELECT step, place, signal, w FROM bw JOIN (SELECT step, row_number() OVER (ORDER BY step) AS place FROM (SELECT DISTINCT step FROM sic)) USING (step)),
bs AS (SELECT bar_idx AS step, ticker, any_value(fwd) AS fwd, sum(w * x) AS score FROM lg JOIN zl ON zl.step = bar_idx AND zl.signal = lg.signal WHERE w > 0 GROUP BY 1, 2),
oo AS (SELECT step, CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS ic FROM (SELECT step, rank() OVER (PARTITION BY step ORDER BY score) + (count(*) OVER (PARTITION BY step, score) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY step ORDER BY fwd) + (count(*) OVER (PARTITION BY step, fwd) - 1) / 2.0::DOUBLE AS ry FROM bs) GROUP BY step),
sr AS (SELECT step, place, ic, anyw FROM (SELECT step, place, sum(w) AS anyw FROM zl GROUP BY 1, 2) LEFT JOIN oo USING (step)),"""


@query(final(BLEND, " SELECT step::BIGINT AS step, round(ic, 6) AS oos_ic, coalesce(anyw > 0 AND count(ic) OVER w >= 6 AND avg(ic) OVER w / (stddev_samp(ic) OVER w / sqrt(count(ic) OVER w)) > 1, false) AS gate_open FROM sr WINDOW w AS (ORDER BY place ROWS BETWEEN 25 PRECEDING AND 2 PRECEDING)"))
def blend_gate(s, d):
    """Whether past out-of-sample coefficients open the gate, step by step."""
    x = _signals(s, d).withColumnRenamed("bar_idx", "step")
    z, labels = x.select("step", "signal", "ticker", F.col("x").alias("z")), x.select("step", "ticker", F.col("fwd").alias("label")).distinct()
    return out(wf.blend(z, labels, 36, 1, 24, 6, 1.0)[0], ["step", "gate_open"], ["oos_ic"])


@query(final(FWD, """ el AS (SELECT ticker, bar_idx FROM (SELECT ticker, bar_idx, quantile_cont(v * vw, 0.5) OVER w AS med, count(v * vw) OVER w AS n FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE n >= 10 AND med >= 100000),
hz AS (SELECT g.bar_idx, g.ticker, h.h, lead(o, 1) OVER w AS o1, CASE h.h WHEN 1 THEN lead(o, 2) OVER w WHEN 2 THEN lead(o, 3) OVER w ELSE lead(o, 6) OVER w END AS o2 FROM grid g CROSS JOIN (VALUES (1), (2), (5)) h(h) WINDOW w AS (PARTITION BY g.ticker, h.h ORDER BY g.bar_idx)),
jo AS (SELECT hz.bar_idx, hz.h, r AS x, o2 / o1 - 1 AS y FROM hz JOIN rets USING (bar_idx, ticker) JOIN el USING (bar_idx, ticker) WHERE r IS NOT NULL AND o1 > 0 AND o2 IS NOT NULL AND hz.bar_idx >= 12 AND (hz.bar_idx - 12) % hz.h = 0 AND hz.bar_idx + 1 + hz.h < (SELECT max(bar_idx) + 1 FROM cal)),
co AS (SELECT bar_idx, h, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS ic FROM (SELECT bar_idx, h, rank() OVER (PARTITION BY bar_idx, h ORDER BY x) + (count(*) OVER (PARTITION BY bar_idx, h, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY bar_idx, h ORDER BY y) + (count(*) OVER (PARTITION BY bar_idx, h, y) - 1) / 2.0::DOUBLE AS ry FROM jo) GROUP BY 1, 2)
SELECT 'mom' AS signal, h::BIGINT AS horizon, count(ic) AS n, round(avg(ic), 7) AS mean, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS t FROM co WHERE ic IS NOT NULL GROUP BY h"""))
def ic_table(s, d):
    """Coefficients of one signal on non-overlapping bars of several horizons, over the eligible names."""
    bars = _bars(s, d)
    grid = tables.dense(bars)
    scores = panel.returns(bars).where("r is not null").select("bar_idx", F.lit("mom").alias("signal"), "ticker", F.col("r").alias("x"))
    end = (bars.agg(F.max("bar_idx")).first()[0] or 0) + 1
    rows = wf.ic_table(scores, grid, panel.eligible(grid, 20, 100_000.0, 1 << 30), (1, 2, 5), 12, end)
    return out(rows.withColumn("t", F.round("t", 6)), ["signal", "horizon", "n"], ["mean", "t"], 7)


@query(final(IC, "SELECT count(*) AS n_ic, round(var_samp(ic), 9) AS var_ic FROM ic WHERE ic IS NOT NULL"))
def registry_stats(s, d):
    return out(wf.registry_stats(_ic(s, d), ("ic",)), ["n_ic"], ["var_ic"], 9)


@query(final(BARS, "SELECT bar_idx::BIGINT AS bar_idx FROM (SELECT max(bar_idx) AS bar_idx FROM cal GROUP BY date_trunc('month', t)) WHERE bar_idx >= 12 AND bar_idx <= (SELECT max(bar_idx) - 1 FROM cal)"))
def rebalance_monthly(s, d):
    return out(panel.rebalance_dates(_bars(s, d), "month", 12), ["bar_idx"])


DAYS = "WITH dy AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS bar_idx FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS t FROM lineitem))"


@query(DAYS + " SELECT bar_idx::BIGINT AS bar_idx FROM (SELECT max(bar_idx) AS bar_idx FROM dy GROUP BY date_trunc('week', t)) WHERE bar_idx >= 20 AND bar_idx <= (SELECT max(bar_idx) - 1 FROM dy)")
def rebalance_weekly(s, d):
    days = tables.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("t")).distinct()
    return out(panel.rebalance_dates(tables.panel(days), "week", 20), ["bar_idx"])


@query(final(BARS, """ sb AS (SELECT bar_idx FROM cal WHERE bar_idx % 3 <> 1), gr AS (SELECT bar_idx FROM sb WHERE bar_idx >= 12 AND bar_idx + 1 + 4 < (SELECT max(bar_idx) + 1 FROM cal))
SELECT bar_idx::BIGINT AS bar_idx FROM (WITH RECURSIVE p AS (SELECT min(bar_idx) AS bar_idx FROM gr UNION ALL SELECT (SELECT min(g.bar_idx) FROM gr g WHERE g.bar_idx >= p.bar_idx + 4) FROM p WHERE p.bar_idx IS NOT NULL) SELECT bar_idx FROM p WHERE bar_idx IS NOT NULL)"""))
def external_bars(s, d):
    """The bars of an external score that count for a horizon of four, one after the other."""
    bars = _bars(s, d)
    end = (bars.agg(F.max("bar_idx")).first()[0] or 0) + 1
    return out(wf.greedy_bars(bars.where("bar_idx % 3 <> 1").select("bar_idx"), 4, 12, end), ["bar_idx"])
