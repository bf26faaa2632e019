"""Queries of layouts, rasters and communities over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import BARS, _bars, _labels, _pi, final, out, query
from ..operators import geometry as geo

COLS, ROWS = 10, 10
VALUES = BARS + " vl AS (SELECT (ticker * 7) % 100 AS cell, avg(c) AS value FROM bars WHERE ticker % 4 = 0 AND ticker < 60 GROUP BY ticker),"


def _values(s, d):
    return _bars(s, d).where("ticker % 4 = 0 and ticker < 60").groupBy("ticker").agg(F.avg("c").alias("value")).select((F.col("ticker") * 7 % 100).alias("cell"), "value")


RASTER = VALUES + """ px AS (SELECT i % 20 AS px, i // 20 AS py, (i % 20 + 0.5::DOUBLE) / 2 AS u, (i // 20 + 0.5::DOUBLE) / 2 AS v FROM range(400) r(i)),
ds AS (SELECT px, py, cell, value, greatest(abs(cell % 10 - floor(u)), abs(cell // 10 - floor(v))) AS steps, sqrt(pow(u - (cell % 10 + 0.5::DOUBLE), 2) + pow(v - (cell // 10 + 0.5::DOUBLE), 2)) AS d FROM px CROSS JOIN vl),
zz AS (SELECT px, py, coalesce(sum(CASE WHEN steps <= 2 THEN value / (d * d) END) / sum(CASE WHEN steps <= 2 THEN 1 / (d * d) END), arg_min(value, steps * 1000 + cell)) AS z FROM ds GROUP BY px, py),"""


def _raster(s, d):
    return geo.idw(_values(s, d), COLS, ROWS, 2, 2, 2.0)


@query(final(RASTER, " SELECT px, py, round(z, 6) AS z FROM zz"))
def idw_raster(s, d):
    """Inverse-distance surface of scattered cells, with the nearest one where none is around."""
    return out(_raster(s, d), ["px", "py"], ["z"])


GAUSS = RASTER + """ hx AS (SELECT a.px, a.py, sum(exp(-0.5 * (a.px - b.px) * (a.px - b.px) / 2.25) * b.z) / sum(exp(-0.5 * (a.px - b.px) * (a.px - b.px) / 2.25)) AS z FROM zz a JOIN zz b ON b.py = a.py AND abs(a.px - b.px) <= 5 GROUP BY 1, 2),
gz AS (SELECT a.px, a.py, sum(exp(-0.5 * (a.py - b.py) * (a.py - b.py) / 2.25) * b.z) / sum(exp(-0.5 * (a.py - b.py) * (a.py - b.py) / 2.25)) AS z FROM hx a JOIN hx b ON b.px = a.px AND abs(a.py - b.py) <= 5 GROUP BY 1, 2),"""


@query(final(GAUSS, " SELECT px, py, round(z, 6) AS z FROM gz"))
def smooth_raster(s, d):
    return out(geo.smooth(_raster(s, d), 1.5), ["px", "py"], ["z"])


STEP = """ c{n} AS (SELECT a.px, a.py, CASE WHEN a.px = 3 AND a.py = 4 THEN 9.0::DOUBLE ELSE 0.5::DOUBLE * any_value(a.z) + 0.5::DOUBLE * sum((CASE WHEN a.px <> b.px AND a.py <> b.py THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) * (eps + abs(b.z)) * b.z) / sum((CASE WHEN a.px <> b.px AND a.py <> b.py THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) * (eps + abs(b.z))) END AS z FROM c{m} a JOIN c{m} b ON abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1 CROSS JOIN ep GROUP BY a.px, a.py),"""


@query(final(RASTER + " c0 AS (SELECT px, py, CASE WHEN px = 3 AND py = 4 THEN 9.0::DOUBLE ELSE z END AS z FROM zz), ep AS (SELECT 0.1::DOUBLE * quantile_disc(abs(z), 0.9) AS eps FROM c0)," + "".join(STEP.format(n=n, m=n - 1) for n in (1, 2, 3)), " SELECT px, py, round(z, 6) AS z FROM c3"))
def cvt_raster(s, d):
    """Three steps of the density-weighted smoother with one pinned pixel."""
    pins = s.createDataFrame([(3, 4, 9.0)], "px long, py long, z double")
    return out(geo.cvt_smooth(_raster(s, d), 3, 0.5, 0.1, pins), ["px", "py"], ["z"])


@query(final(GAUSS, " SELECT px, py, round(gz.z - zz.z, 6) AS z FROM gz JOIN zz USING (px, py)"))
def raster_delta(s, d):
    r = _raster(s, d)
    return out(geo.delta(r, geo.smooth(r, 1.5)), ["px", "py"], ["z"])


def _layout(s, d):
    nodes = _labels(s, d).join(_pi(s, d), "node").select(F.lit(0).cast("long").alias("frame"), "node", "community", F.round("pi", 10).alias("value"))
    n = nodes.count()
    cols, rows = geo.lattice_size(n + n // 5)
    return geo.territory_layout(nodes, cols, rows)


@query()
def layout(s, d):
    """Where a landscape puts its nodes: sequential by definition; tests hold it against its rules."""
    return _layout(s, d).drop("mountain")


@query("""WITH a AS (SELECT s_suppkey AS node, s_nationkey::BIGINT AS community FROM supplier), b AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 4 = 0 THEN (s_nationkey + 1) % 25 ELSE s_nationkey END::BIGINT AS community FROM supplier WHERE s_suppkey % 9 <> 0),
o AS (SELECT a.community AS new, b.community AS old, count(*) AS shared FROM a JOIN b USING (node) GROUP BY 1, 2) SELECT new, old, shared, round(shared / (x.n + y.n - shared)::DOUBLE, 8) AS jaccard, round(shared / x.n::DOUBLE, 8) AS contained FROM o JOIN (SELECT community, count(*) AS n FROM a GROUP BY 1) x ON x.community = new JOIN (SELECT community, count(*) AS n FROM b GROUP BY 1) y ON y.community = old""")
def label_overlaps(s, d):
    new, old = _two_labels(s, d)
    return out(geo.overlaps(new, old), ["new", "old", "shared"], ["jaccard", "contained"], 8)


def _two_labels(s, d):
    new = _labels(s, d)
    moved = F.when(F.col("node") % 4 == 0, (F.col("community") + 1) % 25).otherwise(F.col("community"))
    return new, new.where("node % 9 <> 0").select("node", moved.alias("community"))


@query()
def matched_labels(s, d):
    """Labels carried from one clustering to the next, the largest overlap first."""
    return geo.match_labels(*_two_labels(s, d))


@query("""WITH l AS (SELECT f AS frame, s_suppkey AS node, ((s_nationkey + CASE WHEN s_suppkey % 5 < f THEN f ELSE 0 END) % 5)::BIGINT AS community FROM supplier CROSS JOIN range(6) r(f))
SELECT frame, lag, n, round(same / own::DOUBLE, 8) AS same_pairs FROM (SELECT a.frame, g.lag, (SELECT count(*) FROM l x WHERE x.frame = a.frame) AS n, count(CASE WHEN c.community = e.community THEN 1 END) AS same, count(*) AS own FROM l a JOIN l b ON b.frame = a.frame AND b.node <> a.node AND b.community = a.community CROSS JOIN (VALUES (1::BIGINT), (3::BIGINT)) g(lag) JOIN l c ON c.frame = a.frame + g.lag AND c.node = a.node JOIN l e ON e.frame = a.frame + g.lag AND e.node = b.node GROUP BY a.frame, g.lag)""")
def cluster_persistence(s, d):
    """How pairs stay together over frames."""
    k = F.col("frame")
    rows = _labels(s, d).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    rows = rows.withColumn("community", (F.col("community") + F.when(F.col("node") % 5 < k, k).otherwise(0)) % 5)
    return out(geo.persistence(rows, (1, 3)).withColumn("lag", F.col("lag").cast("long")), ["frame", "lag", "n"], ["same_pairs"], 8)


@query(final(BARS, "SELECT ticker % 10 AS x, (ticker // 10) % 10 AS y, round(avg(c), 6) AS z FROM bars GROUP BY 1, 2"))
def lattice_means(s, d):
    g = _bars(s, d).groupBy((F.col("ticker") % 10).alias("x"), (F.floor(F.col("ticker") / 10) % 10).alias("y")).agg(F.avg("c").alias("z"))
    return out(g, ["x", "y"], ["z"])
