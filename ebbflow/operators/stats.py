"""Cross-sectional statistics. Every rank names its tie rule; missing values are null and drop out in pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_rank(x: str, by: list[str]):
    """Rank from 1, ties sharing their mean."""
    w, same = Window.partitionBy(*by).orderBy(x), Window.partitionBy(*by, x)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2


def correlation(x: str, y: str):
    """Pearson correlation as an aggregate; null where a side has no variance (``corr`` fails there)."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def spearman(df: DataFrame, x: str, y: str, by: list[str], least: int = 3) -> DataFrame:
    """(by, ic, n): rank correlation within each group; null for fewer than ``least`` pairs or no variance."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumns({"rx": average_rank(x, by), "ry": average_rank(y, by)})
    out = rows.groupBy(*by).agg(correlation("rx", "ry").alias("ic"), F.count("*").alias("n"), F.var_pop("rx").alias("vx"), F.var_pop("ry").alias("vy"))
    return out.select(*by, F.when((F.col("n") >= least) & (F.col("vx") > 0) & (F.col("vy") > 0), F.col("ic")).alias("ic"), "n")


def gini(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """2 sum(i x_i) / (n sum x) - (n + 1) / n over the values in ascending order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(x))
    rows = df.where(F.col(x).isNotNull()).withColumn("i", place)
    n = F.count("*")
    return rows.groupBy(*by).agg((2 * F.sum(F.col("i") * F.col(x)) / (n * F.sum(x)) - (n + 1) / n).alias("gini"))


def zscore(df: DataFrame, x: str, by: list[str], clamp: float = 3.0) -> DataFrame:
    """``z`` by population deviation, clamped; 0 where there is no variance."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(x).over(w)
    z = F.when(sd > 0, (F.col(x) - F.avg(x).over(w)) / sd).otherwise(0.0)
    return df.withColumn("z", F.greatest(F.lit(-clamp), F.least(F.lit(clamp), z)))


def mean_t(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """(by, mean, t, n) with t = mean / (sd / sqrt n)."""
    t = F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), t.alias("t"), F.count(x).alias("n"))


def norm_inv(p):
    """Inverse normal distribution by a rational approximation in three ranges, as a column."""
    #: Coefficients of the published approximation (relative error below 1.15e-9).
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def poly(x, k):
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    q = p - 0.5
    r = q * q
    mid = poly(r, a) * q / (poly(r, b) * r + 1)
    low = F.sqrt(-2 * F.ln(p))
    high = F.sqrt(-2 * F.ln(1 - p))
    return F.when(p < 0.02425, poly(low, c) / (poly(low, d) * low + 1)).when(p > 1 - 0.02425, -poly(high, c) / (poly(high, d) * high + 1)).otherwise(mid)


def norm_cdf(x):
    """Normal distribution as a column, by a rational function and, far out, a continued fraction."""
    #: Coefficients of the published double-precision approximation.
    top = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    low = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

    def poly(a, k):
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * a + v
        return out

    a = F.abs(x)
    bell = F.exp(-a * a / 2)
    far = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = a + k / far
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, bell * poly(a, top) / poly(a, low)).otherwise(bell / far / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def rank_gauss(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """``g``: inverse normal of (average rank - 1/2) / n within each group."""
    n = F.count("*").over(Window.partitionBy(*by))
    return df.where(F.col(x).isNotNull()).withColumn("g", norm_inv((average_rank(x, by) - 0.5) / n))


def partition_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (nmi, ari) for two labellings of the same rows, from the contingency table."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    wa, wb = Window.partitionBy(a), Window.partitionBy(b)
    total = cells.agg(F.sum("n").alias("t"))
    rows = cells.withColumns({"na": F.sum("n").over(wa), "nb": F.sum("n").over(wb)}).crossJoin(total)  # one row
    t = F.col("t")
    # each margin is spread over its cells, so that one pass sums cells and margins
    pa, pb = F.col("na") / t, F.col("nb") / t
    mi = F.sum(F.col("n") / t * F.ln(F.col("n") * t / (F.col("na") * F.col("nb"))))
    ha, hb = -F.sum(F.col("n") / t * F.ln(pa)), -F.sum(F.col("n") / t * F.ln(pb))
    c2 = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    ca, cb = F.sum(F.col("n") * (F.col("na") - 1) / 2), F.sum(F.col("n") * (F.col("nb") - 1) / 2)
    out = rows.agg(mi.alias("mi"), ha.alias("ha"), hb.alias("hb"), c2.alias("c2"), ca.alias("ca"), cb.alias("cb"), F.max("t").alias("t"))
    pairs = F.col("t") * (F.col("t") - 1) / 2
    expect = F.col("ca") * F.col("cb") / pairs
    return out.select(F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb")).alias("nmi"), F.try_divide(F.col("c2") - expect, (F.col("ca") + F.col("cb")) / 2 - expect).alias("ari"))


def sparse_pair_spearman(x: DataFrame, y: DataFrame, n_nodes) -> DataFrame:
    """Spearman over all n (n - 1) ordered pairs of two edge lists (src, dst, w > 0) without the zero pairs being made:
    they share the rank (zeros + 1) / 2."""
    total = n_nodes.select((F.col("n") * (F.col("n") - 1)).cast("double").alias("t"))

    def ranked(e, name):
        m = e.agg(F.count("*").alias("m"))
        rows = global_average_rank(e, "w", "place").crossJoin(m).crossJoin(total)
        zero = F.col("t") - F.col("m")
        return rows.select("src", "dst", (zero + F.col("place")).alias(name)), e.agg(F.count("*").cast("double").alias(f"m{name}"))

    rx, mx = ranked(x, "x")
    ry, my = ranked(y, "y")
    both = rx.join(ry, ["src", "dst"], "full").crossJoin(total).crossJoin(mx).crossJoin(my)  # one row each
    zx, zy = (F.col("t") - F.col("mx") + 1) / 2, (F.col("t") - F.col("my") + 1) / 2
    mean = (F.col("t") + 1) / 2
    dx, dy = F.coalesce("x", zx) - mean, F.coalesce("y", zy) - mean
    s = both.agg(F.sum(dx * dy).alias("xy"), F.sum(dx * dx).alias("xx"), F.sum(dy * dy).alias("yy"), F.count("*").alias("k"), F.max("t").alias("t"), F.max(zx - mean).alias("ex"), F.max(zy - mean).alias("ey"))
    rest = F.col("t") - F.col("k")
    return s.select(F.try_divide(F.col("xy") + rest * F.col("ex") * F.col("ey"), F.sqrt((F.col("xx") + rest * F.col("ex") ** 2) * (F.col("yy") + rest * F.col("ey") ** 2))).alias("rho"))


#: Fixed value: bits of a positive double that are left out where values are counted by their leading bits.
LOW_BITS = 43


def leading(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of positive ``v``, equal for values within a fifth of a per cent."""
    return v.view(np.int64) >> LOW_BITS


def _alike(v: np.ndarray, o: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs (v, o) in order, with the sums of ``n``."""
    order = np.lexsort((o, v))
    v, o, n = v[order], o[order], n[order]
    new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])])
    return v[new], o[new], np.add.reduceat(n, new)


class Ranges:
    """Ranges of about ``many`` values, from how many there are by ``leading`` (sorted keys and counts)."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, many: int):
        below = np.cumsum(n) - n
        at = np.unique(below // many, return_index=True)[1]
        self.keys, self.below = keys[at], below[at]

    def deal(self, v: np.ndarray, o: np.ndarray, n: np.ndarray):
        """Record batches (part, v, o, n) with a row for each range; equal pairs are one."""
        import pyarrow as pa

        if not len(v):
            return
        v, o, n = _alike(v, o, n)
        part = np.searchsorted(self.keys, leading(v), "right") - 1
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        first = pa.array(np.r_[cut, len(v)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(first, pa.array(c)) for c in (v, o, n)]
        yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), *lists], ["part", "v", "o", "n"])

    def ranks(self, part: int, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The rank of each of a range's values among all, ties sharing their mean."""
        _, at = np.unique(v, return_inverse=True)
        same = np.bincount(at, n)
        return (self.below[part] + np.cumsum(same) - same + (same + 1) / 2)[at]


def formed_pair_spearman(rows: DataFrame, form, t: float, counts: dict[str, tuple[np.ndarray, np.ndarray]], many: int = 2_000_000) -> DataFrame:
    """One row (rho) as ``sparse_pair_spearman``, of edges that ``form`` makes from batches of ``rows`` as (sources, row, dst,
    x, y). ``counts`` has the numbers of positive x and y by ``leading``, ``t`` is the number of all pairs.

    Once x and y of an edge have met in its source's task its ends are not needed: pairs (x, y) are counted there and go
    to the range of their x, which gives the rank, then with it to the range of their y."""
    rx, ry = Ranges(*counts["x"], many), Ranges(*counts["y"], many)
    mean, mx, my = (t + 1) / 2, float(counts["x"][1].sum()), float(counts["y"][1].sum())
    ex, ey = (t - mx + 1) / 2 - mean, (t - my + 1) / 2 - mean
    kind = "part int, v array<double>, o array<double>, n array<long>"

    def dealt(ranges, pick):
        def run(batches):
            held, size = [], 0
            for *_, x, y in form(batches):
                v, o = pick(x, y)
                held.append(_alike(v, o, np.ones(len(v), np.int64)) if len(v) else (v, o, np.zeros(0, np.int64)))
                size += len(held[-1][0])
                if size > 500_000:
                    yield from ranges.deal(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
            if held:
                yield from ranges.deal(*map(np.concatenate, zip(*held, strict=True)))

        return run

    def columns(table):
        return [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("v", "o", "n")]

    def by_x(key, table):
        import pyarrow as pa

        v, o, n = columns(table)
        dx = rx.ranks(key[0].as_py(), v, n) + (t - mx) - mean
        both = o != 0
        told = [float((n * dx)[~both].sum() * ey), float((n * dx * dx).sum())]
        out = [pa.RecordBatch.from_pydict({"part": pa.array([-1], pa.int32()), "v": [told], "o": [[0.0, 0.0]], "n": [[0, 0]]})]
        return pa.Table.from_batches([*out, *ry.deal(o[both], dx[both], n[both])])

    def by_y(key, table):
        import pyarrow as pa

        v, o, n = columns(table)
        if key[0].as_py() < 0:
            xy, xx, yy = v[::2].sum(), v[1::2].sum(), 0.0
        else:
            dy = ry.ranks(key[0].as_py(), v, n) + (t - my) - mean
            xy, xx, yy = (n * dy * o).sum(), 0.0, (n * dy * dy).sum()
        here = n[o != ex].sum() if key[0].as_py() >= 0 else 0
        return pa.table({"xy": [float(xy)], "xx": [float(xx)], "yy": [float(yy)], "k": [float(here)]})

    met = rows.mapInArrow(dealt(rx, lambda x, y: (x[x != 0], y[x != 0])), kind).groupBy("part").applyInArrow(by_x, kind)
    alone = rows.mapInArrow(dealt(ry, lambda x, y: (y[x == 0], np.full((x == 0).sum(), ex))), kind)
    sums = met.unionByName(alone).groupBy("part").applyInArrow(by_y, "xy double, xx double, yy double, k double")
    s = sums.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("xy", "xx", "yy", "k")])
    rest = F.lit(t - mx - my) + F.col("k")  # pairs without either: those with both are counted in mx and in my
    var = (F.col("xx") + F.lit((t - mx) * ex * ex)) * (F.col("yy") + F.lit((t - my) * ey * ey))
    return s.select(F.try_divide(F.col("xy") + rest * F.lit(ex * ey), F.sqrt(var)).alias("rho"))


def buckets(df: DataFrame, value: str, many: int = 64):
    """A column that numbers ranges of ``value`` in ascending order, of about as many rows each: a rank over all rows is
    then a rank within a range and a sum over the few ranges before it, and no task sorts them all."""
    cuts = sorted(set(df.approxQuantile(value, [k / many for k in range(1, many)], 0.005)))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(value))) if cuts else F.lit(0)


def global_place(df: DataFrame, value: str, ties: list[str], descending: bool = False, name: str = "place") -> DataFrame:
    """``df`` with the place of each row by ``value``, then ``ties``, from 1; without a sort of all rows in one task."""
    rows = df.withColumn("__range", buckets(df, value))
    key = F.desc(value) if descending else F.col(value)
    place = F.row_number().over(Window.partitionBy("__range").orderBy(key, *ties))
    return _offset(rows.withColumn("__in", place), descending, name)


def global_average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the rank of each row by ``value``, ties sharing their mean; without a sort of all rows in one task."""
    rows = df.withColumn("__range", buckets(df, value))
    inside = F.rank().over(Window.partitionBy("__range").orderBy(value)) + (F.count("*").over(Window.partitionBy("__range", value)) - 1) / 2
    return _offset(rows.withColumn("__in", inside), False, name)


def _offset(rows: DataFrame, descending: bool, name: str) -> DataFrame:
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    order = F.desc("__range") if descending else F.col("__range")
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy(order)) - F.col("__n")).alias("__before"))  # a row for each range
    return rows.join(F.broadcast(before), "__range").withColumn(name, F.col("__in") + F.col("__before")).drop("__range", "__in", "__before")


def spearman_all(df: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    """One row (ic, n): rank correlation over all rows with both values; null for fewer than ``least`` or no variance."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    rows = global_average_rank(global_average_rank(rows, x, "rx"), y, "ry")
    out = rows.agg(correlation("rx", "ry").alias("ic"), F.count("*").alias("n"), F.var_pop("rx").alias("vx"), F.var_pop("ry").alias("vy"))
    return out.select(F.when((F.col("n") >= least) & (F.col("vx") > 0) & (F.col("vy") > 0), F.col("ic")).alias("ic"), "n")


def summary(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """(by, n, mean, median, q25, q75) with interpolated quantiles."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), q.alias("q")).select(*by, "n", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"))


def spread(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """(by, n, positive, mean, sd, min, max) of the values that there are."""
    return df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col(x) > 0, 1)).alias("positive"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"))


def best_by(df: DataFrame, score: str, name: str, by: list[str]) -> DataFrame:
    """(by, name, score, runner_up, margin): the largest score of each group, the next one and the distance to it."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), name)
    rows = df.where(F.col(score).isNotNull()).withColumns({"place": F.row_number().over(w), "runner_up": F.lead(name).over(w), "next": F.lead(score).over(w)})
    return rows.where("place = 1").select(*by, name, score, "runner_up", (F.col(score) - F.col("next")).alias("margin"))


def pearson(df: DataFrame, x: str, y: str, by: list[str], least: int = 3) -> DataFrame:
    """(by, r, n): correlation of the pairs of each group; null for fewer than ``least`` or no variance."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(correlation(x, y).alias("r"), F.count("*").alias("n"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    return rows.select(*by, F.when((F.col("n") >= least) & (F.col("vx") > 0) & (F.col("vy") > 0), F.col("r")).alias("r"), "n")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (auc, n, positives): the chance that a row with the label outranks one without, ties by half."""
    rows = global_average_rank(df.where(F.col(score).isNotNull()).select(score, F.col(label).cast("int").alias("y")), score, "rank")
    n, m = F.count("*"), F.sum("y")
    ranks = F.sum(F.when(F.col("y") == 1, F.col("rank")).otherwise(0.0))
    return rows.agg(F.try_divide(ranks - m * (m + 1) / 2, (m * (n - m)).cast("double")).alias("auc"), n.alias("n"), m.alias("positives"))


def softmax(df: DataFrame, x: str, by: list[str], name: str = "w") -> DataFrame:
    """``df`` with weights that sum to 1 in each group: exp(x - max) over their sum."""
    w = Window.partitionBy(*by)
    rows = df.withColumn(name, F.exp(F.col(x) - F.max(x).over(w)))
    return rows.withColumn(name, F.col(name) / F.sum(name).over(w))


def permuted(df: DataFrame, value: str, key: str, by: list[str], seed: int, name: str = "permuted") -> DataFrame:
    """``df`` with the values of each group dealt anew: the value of the row that stands, in the order of the digests of
    seed and key, where this row stands in the order of its key."""
    own = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    dealt = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key))
    other = df.select(*by, F.col(value).alias(name), dealt.alias("place"))
    return df.withColumn("place", own).join(other, [*by, "place"]).drop("place")


def window_sums(df: DataFrame, x: str, by: str, order: str, widths: tuple[int, ...]) -> DataFrame:
    """``df`` with r<k> for each width: the sum over the last k bars up to this one; null where they hold no value."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumns({f"r{k}": F.sum(x).over(w.rangeBetween(1 - k, 0)) for k in widths})


def monthly_units(ic: DataFrame, at: str, units: list[str]) -> DataFrame:
    """(units, n, mean) of coefficients by unit, the units then being the cases: ``mean_t`` over them is clustered."""
    return ic.where("ic is not null").groupBy(*units).agg(F.avg("ic").alias("mean"), F.count("*").alias("n"))


def tail_spread(df: DataFrame, score: str, value: str, by: list[str], tie: str, parts: int = 10) -> DataFrame:
    """(by, spread, n): mean of the best part less that of the worst, of ``parts`` by score."""
    part = F.ntile(parts).over(Window.partitionBy(*by).orderBy(score, tie))
    rows = df.where(F.col(score).isNotNull() & F.col(value).isNotNull()).withColumn("part", part)
    return rows.groupBy(*by).agg((F.avg(F.when(F.col("part") == parts, F.col(value))) - F.avg(F.when(F.col("part") == 1, F.col(value)))).alias("spread"), F.count("*").alias("n"))
