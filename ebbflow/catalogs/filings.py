"""Queries of quarterly holdings: filings, units, prices, splits and observed flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FILED, FLUX, HOLD, TWO, _flux, _nodes, _p, final, out, query
from ..operators import flux
from ..operators import holdings as ho
from ..sources import tables

A, B = "1996Q1", "1996Q2"


def _hold(s, d):
    return tables.holdings(s, d)


INFO = "WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS place, 'c' || (l_partkey % 50) || CASE l_linenumber WHEN 1 THEN ' ' ELSE '' END AS cusip0, CASE l_returnflag WHEN 'R' THEN 'PRN' ELSE 'sh ' END AS kind, CASE l_linestatus || l_linenumber WHEN 'O2' THEN 'Put' ELSE '' END AS put_call, l_suppkey AS cik, l_quantity AS shares, l_extendedprice AS value_usd, 'Issuer ' || l_suppkey AS issuer FROM lineitem),"


def _info(s, d):
    li = tables.table(s, d, "lineitem")
    cusip = F.concat(F.lit("c"), (F.col("l_partkey") % 50).cast("string"), F.when(F.col("l_linenumber") == 1, " ").otherwise(""))
    put = F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 2), "Put").otherwise("")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), cusip.alias("cusip"), F.when(F.col("l_returnflag") == "R", "PRN").otherwise("sh ").alias("kind"), put.alias("put_call"), F.col("l_suppkey").alias("cik"), F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("value_usd"), F.concat(F.lit("Issuer "), F.col("l_suppkey").cast("string")).alias("issuer"))


@query(INFO + " g AS (SELECT *, upper(trim(cusip0)) AS cusip FROM i WHERE upper(trim(kind)) = 'SH' AND trim(put_call) = '' AND trim(cusip0) <> '') SELECT cik, cusip, arg_min(issuer, place) AS issuer, round(sum(shares), 4) AS shares, round(sum(value_usd), 4) AS value_usd FROM g GROUP BY cik, cusip")
def filed_positions(s, d):
    """Rows of information tables that count, summed by manager and identifier."""
    rows = ho.aggregate(ho.filed_rows(_info(s, d)).withColumn("quarter", F.lit("q")))
    return out(rows.drop("quarter"), ["cik", "cusip", "issuer"], ["shares", "value_usd"], 4)


@query(INFO + " g AS (SELECT upper(trim(cusip0)) AS cusip, value_usd FROM i) SELECT cusip, round(sum(value_usd), 3) AS value, max(value_usd) >= 100000 AS wanted FROM g GROUP BY cusip")
def wanted_identifiers(s, d):
    return out(ho.wanted(_info(s, d), 100_000.0), ["cusip", "wanted"], ["value"], 3)


MAP = " m AS (SELECT cusip, arg_max(ticker, place) AS ticker FROM (SELECT 'C' || (p_partkey % 50) AS cusip, p_partkey AS place, CASE p_partkey % 3 WHEN 0 THEN '' ELSE p_brand END AS ticker FROM part WHERE p_partkey % 50 < 40) WHERE ticker <> '' GROUP BY cusip), h AS (SELECT CASE WHEN place % 10 = 7 THEN NULL ELSE cik END AS cik, upper(trim(cusip0)) AS cusip, shares, value_usd FROM i),"


def _mapped(s, d):
    part = tables.table(s, d, "part").where("p_partkey % 50 < 40")
    m = part.select(F.concat(F.lit("C"), (F.col("p_partkey") % 50).cast("string")).alias("cusip"), F.col("p_partkey").alias("place"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")).alias("ticker"))
    rows = _info(s, d).withColumn("cik", F.when(F.col("place") % 10 != 7, F.col("cik"))).withColumn("cusip", F.upper(F.trim("cusip")))
    return ho.mapped(rows, m)


@query(final(INFO + MAP, " SELECT round(sum(CASE WHEN cik IS NOT NULL THEN value_usd ELSE 0 END), 2) AS total_value, round(sum(CASE WHEN cik IS NOT NULL AND ticker IS NULL THEN value_usd ELSE 0 END), 2) AS dropped_value, count(CASE WHEN cik IS NULL THEN 1 END) AS bad_rows FROM h LEFT JOIN m USING (cusip)"))
def loaded_quarter(s, d):
    """What of a quarter's holdings is mapped to tickers, dropped or bad."""
    return out(_mapped(s, d)[1], ["bad_rows"], ["total_value", "dropped_value"], 2)


@query(final(INFO + MAP, " SELECT ticker, count(*) AS n, round(sum(value_usd), 2) AS value FROM h JOIN m USING (cusip) WHERE cik IS NOT NULL GROUP BY ticker"))
def mapped_holdings(s, d):
    return out(_mapped(s, d)[0].groupBy("ticker").agg(F.count("*").alias("n"), F.sum("value_usd").alias("value")), ["ticker", "n"], ["value"], 2)


@query("""WITH f AS (SELECT o_orderkey AS accession, CASE o_orderstatus WHEN 'P' THEN '13F-NT' WHEN 'F' THEN '13F-HR' ELSE '13F-HR/A' END AS form, CASE WHEN o_orderkey % 5 = 0 THEN 'y' ELSE '' END AS am, CASE o_orderkey % 3 WHEN 0 THEN 'Restatement' WHEN 1 THEN 'new holdings' ELSE '' END AS ty FROM orders)
SELECT accession, CASE WHEN form <> '13F-NT' THEN CASE WHEN form = '13F-HR' AND am <> 'y' THEN 'keep' WHEN upper(ty) = 'RESTATEMENT' THEN 'replace' WHEN upper(ty) = 'NEW HOLDINGS' THEN 'add' ELSE 'unknown' END END AS kind FROM f""")
def amendment_kinds(s, d):
    k = F.col("o_orderkey")
    form = F.when(F.col("o_orderstatus") == "P", "13F-NT").when(F.col("o_orderstatus") == "F", "13F-HR").otherwise("13F-HR/A")
    ty = F.when(k % 3 == 0, "Restatement").when(k % 3 == 1, "new holdings").otherwise("")
    return tables.table(s, d, "orders").select(k.alias("accession"), ho.amendment_kind(form, F.when(k % 5 == 0, "y").otherwise(""), ty).alias("kind"))


KINDS = FILED.replace("WHEN '1' THEN 'original' WHEN '2' THEN 'restatement' WHEN '3' THEN 'new holdings' ELSE 'original' END", "WHEN '1' THEN 'keep' WHEN '2' THEN 'replace' WHEN '3' THEN 'add' WHEN '4' THEN 'unknown' ELSE 'add' END").replace("n AS (SELECT *, row_number()", "n AS (SELECT *, row_number()").replace("FROM f)", "FROM f WHERE kind <> 'unknown')", 1).replace("kind <> 'new holdings'", "kind <> 'add'")


@query(KINDS + " SELECT accession, kind FROM n LEFT JOIN b USING (cik, period) WHERE base IS NULL OR n >= base")
def amendments(s, d):
    """Filings that count, with additions alone where no original is known."""
    o = tables.table(s, d, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    kind = F.when(first == "1", "keep").when(first == "2", "replace").when(first == "4", "unknown").otherwise("add")
    f = o.select(F.col("o_custkey").alias("cik"), F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("period"), F.col("o_orderdate").alias("filed"), F.col("o_orderkey").alias("accession"), kind.alias("kind"))
    return ho.apply_amendments(f)


def dec(x: str) -> str:
    return f"CASE WHEN round({x} / (3 * ln(10))) <> 0 AND abs({x} - 3 * round({x} / (3 * ln(10))) * ln(10)) < ln(3) THEN (3 * round({x} / (3 * ln(10))))::INT ELSE 0 END"


def flags(source: str, tag: str) -> str:
    return f""" mid{tag} AS (SELECT quarter, ticker, quantile_cont(lp, 0.5) AS mid FROM {source} GROUP BY 1, 2 HAVING count(*) >= 5),
dv{tag} AS (SELECT quarter, cik, lp - mid AS dev FROM x JOIN mid{tag} USING (quarter, ticker)),
md{tag} AS (SELECT quarter, cik, quantile_cont(dev, 0.5) AS med, count(*) AS n FROM dv{tag} GROUP BY 1, 2 HAVING count(*) >= 5),
fl{tag} AS (SELECT quarter, cik, k FROM (SELECT quarter, cik, n, {dec('med')} AS k FROM md{tag}) JOIN dv{tag} USING (quarter, cik) WHERE k <> 0 GROUP BY quarter, cik, k, n HAVING count(CASE WHEN {dec('dev')} = k THEN 1 END) >= 0.6 * n),"""


UNITS = HOLD + " x0 AS (SELECT quarter, cik, ticker, shares, CASE WHEN cik % 7 = 0 THEN value_usd * 1000 WHEN cik % 11 = 0 THEN value_usd / 1000 ELSE value_usd END AS value_usd FROM hold), x AS (SELECT *, ln(value_usd / shares) AS lp FROM x0 WHERE shares > 0 AND value_usd > 0)," + flags("x", "1") + " y AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM fl1 WHERE fl1.quarter = x.quarter AND fl1.cik = x.cik))," + flags("y", "2")


def _mixed(s, d):
    k = F.col("cik")
    return _hold(s, d).withColumn("value_usd", F.when(k % 7 == 0, F.col("value_usd") * 1000).when(k % 11 == 0, F.col("value_usd") / 1000).otherwise(F.col("value_usd")))


@query(final(UNITS, " SELECT quarter, cik, k::BIGINT AS decades FROM fl2"))
def unit_consensus(s, d):
    """Managers whose values are in other units, in two passes."""
    return out(ho.unit_scale(_mixed(s, d)), ["quarter", "cik", "decades"])


@query(final(UNITS, " SELECT quarter, round(sum(value_usd / pow(10.0::DOUBLE, coalesce(k, 0))), 2) AS value FROM x0 LEFT JOIN fl2 USING (quarter, cik) GROUP BY quarter"))
def normalised_values(s, d):
    return out(ho.normalised(_mixed(s, d)).groupBy("quarter").agg(F.sum("value_usd").alias("value")), ["quarter"], ["value"], 2)


PRICED = HOLD + f""" z AS (SELECT quarter, cik, ticker, CASE WHEN quarter = '{B}' AND ticker LIKE '%1' THEN shares * 2 ELSE shares END AS shares, value_usd FROM hold),
cl AS (SELECT year(l_shipdate) || 'Q' || quarter(l_shipdate) AS quarter, date_trunc('month', l_shipdate) AS t, p_brand AS ticker, sum(l_extendedprice) / sum(l_quantity) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
rw AS (SELECT quarter, ticker, quantile_cont(value_usd / shares, 0.5) AS raw FROM z WHERE shares > 0 AND value_usd > 0 GROUP BY 1, 2), aj AS (SELECT quarter, ticker, max_by(c, t) AS last, avg(c) AS mc FROM cl WHERE c > 0 GROUP BY 1, 2), fa AS (SELECT quarter, ticker, raw / last AS f FROM rw JOIN aj USING (quarter, ticker)),
sr AS (SELECT ticker, b / a AS x FROM (SELECT cik, ticker, sum(CASE WHEN quarter = '{A}' THEN shares END) AS a, sum(CASE WHEN quarter = '{B}' THEN shares END) AS b FROM z WHERE shares > 0 AND quarter IN ('{A}', '{B}') GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL),
nm AS (SELECT DISTINCT ticker FROM cl), pp AS (SELECT ticker, p.f AS fp, c.f AS fc, mc, p.f / c.f AS r FROM nm LEFT JOIN (SELECT * FROM fa WHERE quarter = '{A}') p USING (ticker) LEFT JOIN (SELECT * FROM fa WHERE quarter = '{B}') c USING (ticker) LEFT JOIN (SELECT * FROM aj WHERE quarter = '{B}') USING (ticker)),
hd AS (SELECT ticker, quantile_cont(x, 0.5) AS med, count(*) AS n, count(CASE WHEN abs(ln(x / r)) < ln(1.01) THEN 1 END) AS ex FROM sr JOIN pp USING (ticker) GROUP BY ticker),
pr AS (SELECT ticker, fp, fc, mc, med, r, CASE WHEN abs(ln(r)) >= ln(1.08) THEN coalesce(abs(ln(med / r)) < least(ln(1.1), abs(ln(r)) / 2), false) OR coalesce(n >= 4 AND ex >= 2 AND ex >= 0.3 * n, false) END AS ok FROM pp LEFT JOIN hd USING (ticker)),
pc AS (SELECT ticker, CASE WHEN ok THEN r ELSE 1.0::DOUBLE END AS ratio, ok AS confirmed, mc * coalesce(fc, fp) AS price FROM pr),"""


def _split_holdings(s, d):
    return _hold(s, d).withColumn("shares", F.when((F.col("quarter") == B) & F.col("ticker").endswith("1"), F.col("shares") * 2).otherwise(F.col("shares")))


def _closes(s, d):
    li, p = tables.table(s, d, "lineitem"), tables.table(s, d, "part")
    quarter = F.concat(F.year("l_shipdate"), F.lit("Q"), F.quarter("l_shipdate"))
    return li.join(p, li.l_partkey == p.p_partkey).groupBy(quarter.alias("quarter"), F.date_trunc("month", "l_shipdate").alias("t"), F.col("p_brand").alias("ticker")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("c"))


@query(final(PRICED, " SELECT ticker, round(fp, 7) AS factor_prev, round(fc, 7) AS factor_cur, round(mc, 6) AS mean_close, round(med, 6) AS median_ratio, round(ratio, 6) AS ratio, confirmed, round(price, 6) AS price FROM pr JOIN pc USING (ticker)"))
def split_pricing(s, d):
    """Prices and splits of a quarter, confirmed by the holders' share counts."""
    rows = ho.split_pricing(_split_holdings(s, d), _closes(s, d), A, B).withColumns({c: F.round(c, 7) for c in ("factor_prev", "factor_cur")})
    return out(rows.withColumns({c: F.round(c, 6) for c in ("mean_close", "median_ratio", "ratio", "price")}), ["ticker", "confirmed"], ["factor_prev", "factor_cur", "mean_close", "median_ratio", "ratio", "price"], 7)


FULL = PRICED + f""" ps AS (SELECT cik, ticker, sum(CASE WHEN quarter = '{B}' THEN shares ELSE 0 END) AS sc, sum(CASE WHEN quarter = '{A}' THEN shares ELSE 0 END) AS sp, sum(CASE WHEN quarter = '{B}' THEN value_usd ELSE 0 END) AS vc, sum(CASE WHEN quarter = '{A}' THEN value_usd ELSE 0 END) AS vp FROM w0 WHERE quarter IN ('{A}', '{B}') GROUP BY 1, 2),
wr AS (SELECT ps.*, pc.price, pc.ratio, coalesce((sc > 0 AND CASE WHEN vc > 0 THEN abs(ln(vc / sc / price)) > ln(100) ELSE sc * price > 1000000 END) OR (sp > 0 AND CASE WHEN vp > 0 THEN abs(ln(vp / sp / (price * ratio))) > ln(100) ELSE sp * price * ratio > 1000000 END), false) AS wrong FROM ps JOIN pc USING (ticker)),
dd AS (SELECT cik, ticker, wrong, vc + vp AS size, CASE WHEN NOT wrong THEN (sc - ratio * sp) * price END AS d FROM wr),
tn AS (SELECT ticker FROM (SELECT ticker, row_number() OVER (ORDER BY round(sum(value_usd), 4) DESC, ticker) AS k FROM w0 WHERE quarter IN ('{A}', '{B}') GROUP BY ticker) WHERE k <= 15),
mm AS (SELECT cik, sum(greatest(-d, 0)) AS so, sum(greatest(d, 0)) AS si FROM dd JOIN tn USING (ticker) WHERE d <> 0 GROUP BY cik),""".replace("FROM w0", "FROM w0")
FULL = FULL.replace(" ps AS (SELECT cik", " w0 AS (SELECT quarter, cik, ticker, shares, CASE WHEN cik % 13 = 0 THEN value_usd * 5000 ELSE value_usd END AS value_usd FROM z), ps AS (SELECT cik", 1)


def _observed(s, d):
    h = _split_holdings(s, d)
    bad = h.withColumn("value_usd", F.when(F.col("cik") % 13 == 0, F.col("value_usd") * 5000).otherwise(F.col("value_usd")))
    return ho.observed(bad, A, B, ho.split_pricing(h, _closes(s, d), A, B), 15)


@query(final(FULL, " SELECT a.ticker AS src, b.ticker AS dst, round(sum(-a.d * b.d * least(so, si) / (so * si)), 2) AS w FROM dd a JOIN dd b USING (cik) JOIN mm USING (cik) WHERE a.d < 0 AND b.d > 0 AND so > 0 AND si > 0 AND a.ticker IN (SELECT ticker FROM tn) AND b.ticker IN (SELECT ticker FROM tn) GROUP BY 1, 2"))
def observed_largest(s, d):
    """Flows between the fifteen largest names, on a common basis, without positions that are out of line."""
    return out(_observed(s, d)[0], ["src", "dst"], ["w"], 2)


@query(final(FULL, " SELECT (SELECT count(DISTINCT cik) FROM dd) AS managers, (SELECT count(*) FROM dd WHERE wrong) AS out_of_line, round((SELECT sum(size) FROM dd WHERE wrong), 0) AS out_of_line_value, round((SELECT sum(d) FROM dd WHERE d > 0 AND ticker NOT IN (SELECT ticker FROM tn)), 2) AS outside_in, round((SELECT -sum(d) FROM dd WHERE d < 0 AND ticker NOT IN (SELECT ticker FROM tn)), 2) AS outside_out, round(sum(least(so, si)), 2) AS paired, round(sum(si - least(so, si)), 2) AS unpaired_in, round(sum(so - least(so, si)), 2) AS unpaired_out FROM mm"))
def observed_totals(s, d):
    rows = _observed(s, d)[1].withColumn("out_of_line_value", F.round("out_of_line_value", 0))
    return out(rows, ["managers", "out_of_line"], ["out_of_line_value", "outside_in", "outside_out", "paired", "unpaired_in", "unpaired_out"], 2)


@query(final(FLUX, " rg AS (SELECT * FROM (VALUES ('early', 0, 20), ('late', 60, 82), ('one', 30, 30)) v(name, first, last)) SELECT name, src, dst, round(sum(w), 3) AS w FROM flux JOIN rg ON bar_idx BETWEEN first AND last GROUP BY 1, 2, 3"))
def estimated_range_flows(s, d):
    ranges = s.createDataFrame([("early", 0, 20), ("late", 60, 82), ("one", 30, 30)], "name string, first int, last int")
    return out(ho.range_flows(_flux(s, d), ranges), ["name", "src", "dst"], ["w"], 3)


def spear(a: str, b: str, source: str) -> str:
    return f"(SELECT corr(x, y) FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0::DOUBLE AS y FROM {source}))"


@query(final(TWO, f""" x0 AS (SELECT src, dst, round(w, 6) AS w FROM ea), y0 AS (SELECT src, dst, round(w, 6) AS w FROM eb),
al AS (SELECT a.node AS src, b.node AS dst, coalesce(x0.w, 0) AS x, coalesce(y0.w, 0) AS y FROM nodes a JOIN nodes b ON a.node <> b.node LEFT JOIN x0 ON x0.src = a.node AND x0.dst = b.node LEFT JOIN y0 ON y0.src = a.node AND y0.dst = b.node),
sh AS (SELECT x / nullif(sum(x) OVER (PARTITION BY src), 0) AS x, y / nullif(sum(y) OVER (PARTITION BY src), 0) AS y FROM al),
hx AS (SELECT src, dst FROM x0 ORDER BY w DESC, src, dst LIMIT 5000), hy AS (SELECT src, dst FROM y0 ORDER BY w DESC, src, dst LIMIT 5000), hv AS (SELECT al.* FROM al JOIN hx USING (src, dst)), un AS (SELECT al.* FROM al JOIN (SELECT * FROM hx UNION SELECT * FROM hy) USING (src, dst)),
mi AS (SELECT dst, sum(x) AS a, sum(y) AS b FROM al GROUP BY dst), mo AS (SELECT src, sum(x) AS a, sum(y) AS b FROM al GROUP BY src)
SELECT round({spear('x', 'y', 'al')}, 6) AS full_spearman, round((SELECT sum(coalesce(x, 0) * coalesce(y, 0)) / sqrt(sum(coalesce(x, 0) * coalesce(x, 0)) * sum(coalesce(y, 0) * coalesce(y, 0))) FROM sh), 6) AS row_cosine, round({spear('x', 'y', 'hv')}, 6) AS obs_topk_spearman, round({spear('x', 'y', 'un')}, 6) AS union_spearman, round({spear('a', 'b', 'mi')}, 6) AS inflow_spearman, round({spear('a', 'b', 'mo')}, 6) AS outflow_spearman,
round((SELECT count(*) FROM ((SELECT src, dst FROM x0 ORDER BY w DESC, src, dst LIMIT 500) INTERSECT (SELECT src, dst FROM y0 ORDER BY w DESC, src, dst LIMIT 500))) / 500.0::DOUBLE, 6) AS top500_overlap, round((SELECT count(*) FROM ((SELECT src, dst FROM x0 ORDER BY w DESC, src, dst LIMIT 2000) INTERSECT (SELECT src, dst FROM y0 ORDER BY w DESC, src, dst LIMIT 2000))) / 2000.0::DOUBLE, 6) AS top2000_overlap"""))
def flow_agreement(s, d):
    """How the flows of the later bars agree with those of the earlier ones."""
    p = _p(s, d).where("p <> 0").persist()  # a number for each ticker and bar, read by every pass
    rows = ho.row_agreement(*flux.split_rows(p, 40), _nodes(s, d).agg(F.count("*").alias("n")))
    return out(rows, [], ["full_spearman", "row_cosine", "obs_topk_spearman", "union_spearman", "inflow_spearman", "outflow_spearman", "top500_overlap", "top2000_overlap"])
