"""Signals, blending, backtest and performance."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import forward_return
from .stats import mean_t, norm_cdf, norm_inv, spearman


def blend_weights(ics: DataFrame, train: int, embargo: int, least: int = 6) -> DataFrame:
    """(step, signal, w): share of the positive mean IC over ``train`` steps that end ``embargo`` steps before."""
    w = Window.partitionBy("signal").orderBy("step").rowsBetween(-(embargo + train), -(embargo + 1))
    rows = ics.withColumns({"m": F.avg("ic").over(w), "n": F.count("ic").over(w)})
    rows = rows.withColumn("pos", F.when(F.col("n") >= least, F.greatest("m", F.lit(0.0))).otherwise(0.0))
    return rows.select("step", "signal", F.coalesce(F.try_divide("pos", F.sum("pos").over(Window.partitionBy("step"))), F.lit(0.0)).alias("w"))


def target_weights(scores: DataFrame, base: DataFrame, tilt: float = 0.2, k: int = 10, cap: float = 0.1, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, step, ticker, w): (1 - tilt) of the base mix plus the tilt over the k best scores, each capped."""
    keys = [*by, "step"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ticker"))
    each = tilt * min(1 / k, cap / tilt)
    top = scores.where("score is not null").withColumn("place", place).where(F.col("place") <= k).select(*keys, "ticker", F.lit(each).alias("w"))
    steps = scores.select(*keys).distinct()
    own = steps.crossJoin(base).select(*keys, "ticker", ((1 - tilt) * F.col("w")).alias("w"))  # the base mix on every step
    return own.unionByName(top).groupBy(*keys, "ticker").agg(F.sum("w").alias("w"))


def simulate(prices: DataFrame, targets: DataFrame, cost_bps: float = 10.0, turnover_cap: float = 0.5) -> DataFrame:
    """(strategy, t, value, cost, turnover): targets (strategy, t, ticker, w) are executed at the open of the bar after
    ``t``; the value is marked at each close from the first execution on.

    A name without an open on the bar keeps its shares; prices carry for valuation alone. The turnover of a rebalance is
    scaled down to the cap, but for the first funding; then buys to what cash and sells pay for; then all holdings and the
    cash to bear the cost. A group is one strategy with the prices of the names it ever wants."""

    def run(left, right):
        import pandas as pd

        if left.empty:
            return pd.DataFrame({"strategy": [], "t": [], "value": [], "cost": [], "turnover": []})
        times = np.sort(right["at"].unique())
        names = np.sort(left["ticker"].unique())
        o, c = (right.dropna(subset=["name"]).pivot(index="at", columns="name", values=x).reindex(index=times, columns=names).to_numpy(float) for x in ("o", "c"))
        wanted = {t: g.set_index("ticker")["w"].reindex(names).fillna(0.0).to_numpy() for t, g in left.groupby("t")}
        cash, shares, last, pending, began, out = 1.0, np.zeros(len(names)), np.full(len(names), np.nan), None, False, []
        for k, t in enumerate(times):
            tradable = np.isfinite(o[k])
            last = np.where(tradable, o[k], last)
            spent = turned = 0.0
            if pending is not None:
                px = np.where(tradable, o[k], 0.0)
                value = cash + np.where(shares != 0, shares * last, 0.0).sum()
                if value > 0:
                    delta = np.where(tradable, pending * value - shares * px, 0.0)
                    turn = np.abs(delta).sum() / (2 * value)
                    if began and turn > turnover_cap:
                        delta = delta * (max(0.0, turnover_cap) / turn)
                    buys, sells = delta[delta > 0].sum(), -delta[delta < 0].sum()
                    if buys > cash + sells:
                        delta = np.where(delta > 0, delta * max(0.0, cash + sells) / buys, delta)
                    spent, turned = cost_bps * 1e-4 * np.abs(delta).sum(), np.abs(delta).sum() / (2 * value) if began else 0.0
                    worth, cash = shares * px + delta, cash - delta.sum()
                    total = worth.sum() + cash
                    if total > spent:
                        worth, cash = worth * (total - spent) / total, cash * (total - spent) / total
                    else:
                        cash -= spent
                    shares = np.where(tradable, worth / np.where(tradable, px, 1.0), shares)
                pending, began = None, True
            last = np.where(np.isfinite(c[k]), c[k], last)
            if began:
                out.append((t, cash + np.where(shares != 0, shares * last, 0.0).sum(), spent, turned))
            if t in wanted:
                pending = wanted[t]
        frame = pd.DataFrame(out, columns=["t", "value", "cost", "turnover"])
        frame.insert(0, "strategy", left["strategy"].iloc[0])
        return frame

    kind = dict(targets.dtypes)["t"]
    held = targets.select(F.col("strategy").alias("of"), F.col("ticker").alias("name")).distinct()
    quotes = prices.select(F.col("t").alias("at"), F.col("ticker").alias("named"), F.col("o").alias("o"), F.col("c").alias("c"))
    per = held.join(quotes, held["name"] == quotes["named"]).select("of", "at", "name", "o", "c")
    # every bar, also those on which none of its names has a price
    none = F.lit(None).cast("double")
    calendar = targets.select(F.col("strategy").alias("of")).distinct().crossJoin(quotes.select("at").distinct())
    per = per.unionByName(calendar.select("of", "at", F.lit(None).cast(dict(quotes.dtypes)["named"]).alias("name"), none.alias("o"), none.alias("c")))
    return targets.groupBy("strategy").cogroup(per.groupBy("of")).applyInPandas(run, f"strategy string, t {kind}, value double, cost double, turnover double")


def benchmarks(decisions: DataFrame, base: DataFrame, eligible: DataFrame, single: int | None = None) -> DataFrame:
    """Targets (strategy, t, ticker, w) of the standing benchmarks over the decision bars (t): the base mix bought once and
    held, the base mix at every decision, one name alone, and equal weights over the eligible (t, ticker) names."""
    first = decisions.agg(F.min("t").alias("t"))
    out = first.crossJoin(base).select(F.lit("buyhold").alias("strategy"), "t", "ticker", "w")  # one row
    out = out.unionByName(decisions.select("t").distinct().crossJoin(F.broadcast(base)).select(F.lit("rebalanced").alias("strategy"), "t", "ticker", "w"))  # a mix is a few names
    if single is not None:
        out = out.unionByName(first.select(F.lit("single").alias("strategy"), "t", F.lit(single).cast("long").alias("ticker"), F.lit(1.0).alias("w")))
    own = eligible.join(decisions.select("t").distinct(), "t")
    each = 1 / F.count("*").over(Window.partitionBy("t"))
    return out.unionByName(own.select(F.lit("ew_eligible").alias("strategy"), "t", "ticker", each.alias("w")))


def curve_returns(curve: DataFrame) -> DataFrame:
    w = Window.partitionBy("strategy").orderBy("t")
    return curve.withColumn("r", F.col("value") / F.lag("value").over(w) - 1)


def performance(curve: DataFrame, per_year: int) -> DataFrame:
    """(strategy, cum, ann, vol, sharpe, drawdown, kurt, n) of value curves; raw kurtosis."""
    w = Window.partitionBy("strategy").orderBy("t")
    rows = curve_returns(curve).withColumn("dd", F.col("value") / F.max("value").over(w) - 1)
    n = F.count("r")
    cum = F.max_by("value", "t") / F.min_by("value", "t") - 1
    return rows.groupBy("strategy").agg(
        cum.alias("cum"), (F.pow(cum + 1, F.lit(float(per_year)) / n) - 1).alias("ann"), (F.stddev_samp("r") * F.sqrt(F.lit(float(per_year)))).alias("vol"),
        F.try_divide(F.avg("r") * F.sqrt(F.lit(float(per_year))), F.stddev_samp("r")).alias("sharpe"), F.min("dd").alias("drawdown"), (F.kurtosis("r") + 3).alias("kurt"), n.alias("n"),
    )


def information_ratio(curve: DataFrame, bench: DataFrame) -> DataFrame:
    """(strategy, ir): returns by each curve's own previous value, joined on common dates."""
    b = curve_returns(bench).select("t", F.col("r").alias("rb"))
    rows = curve_returns(curve).join(b, "t").where("r is not null and rb is not null").withColumn("d", F.col("r") - F.col("rb"))
    return rows.groupBy("strategy").agg(F.try_divide(F.avg("d"), F.stddev_samp("d")).alias("ir"))


def against(curve: DataFrame, bench: DataFrame | str, per_year: int, least_days: int = 120) -> DataFrame:
    """(strategy, T, cum, ann, vol, sharpe_period, sharpe, ann_excess, ir_period, ir, drawdown, years, year_hit_rate, skew,
    kurt, skew_e, kurt_e) over the dates that a curve (strategy, t, day, value) shares with the benchmark: a frame (t, value), or the name of
    one of the curves, whose excess over itself is then exactly 0 (a second evaluation may differ in its last digits).

    Returns are by each curve's own value before (1 at its start); a deviation of next to nothing gives no ratio; skewness
    is the population's and kurtosis raw; a year counts with ``least_days`` dates at least."""
    w, b = Window.partitionBy("strategy").orderBy("t"), Window.orderBy("t")
    own = curve.withColumn("r", F.col("value") / F.coalesce(F.lag("value").over(w), F.lit(1.0)) - 1)
    if isinstance(bench, str):
        rows = own.withColumn("rb", F.max(F.when(F.col("strategy") == bench, F.col("r"))).over(Window.partitionBy("t"))).where("rb is not null")
    else:
        other = bench.select("t", (F.col("value") / F.coalesce(F.lag("value").over(b), F.lit(1.0)) - 1).alias("rb"))  # one benchmark's bars
        rows = own.join(other, "t")
    rows = rows.withColumn("e", F.col("r") - F.col("rb"))
    level = F.exp(F.sum(F.ln(1 + F.col("r"))).over(w))
    rows = rows.withColumn("level", level)
    peak = F.greatest(F.lit(1.0), F.max("level").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("fall", 1 - F.col("level") / peak)
    years = rows.groupBy("strategy", F.year("day").alias("year")).agg(F.count("*").alias("n"), F.sum("e").alias("sum")).where(F.col("n") >= least_days)
    years = years.groupBy("strategy").agg(F.count("*").alias("years"), F.avg((F.col("sum") > 0).cast("double")).alias("year_hit_rate"))

    def moment(x, k):
        return F.avg(F.pow(F.col(x) - F.col(f"m_{x}"), F.lit(float(k))))

    mean = rows.groupBy("strategy").agg(F.avg("r").alias("m_r"), F.avg("e").alias("m_e"))
    n = F.count("*").cast("double")
    g = rows.join(mean, "strategy").groupBy("strategy", "m_r", "m_e").agg(
        F.count("*").alias("T"), F.max_by("level", "t").alias("end"), F.stddev_samp("r").alias("sd"), F.stddev_samp("e").alias("sde"), F.max("fall").alias("drawdown"),
        *[moment(x, k).alias(f"{x}{k}") for x in "re" for k in (2, 3, 4)], n.alias("n"),
    )
    year = F.sqrt(F.lit(float(per_year)))

    def ratio(m, sd):
        return F.when(F.col(sd) > 1e-12 * F.greatest(F.lit(1.0), F.abs(F.col(m))), F.col(m) / F.col(sd))

    shape = [F.when(F.col(f"{x}2") > 1e-24, v).alias(name) for x, tag in (("r", ""), ("e", "_e")) for name, v in ((f"skew{tag}", F.col(f"{x}3") / F.pow(F.col(f"{x}2"), F.lit(1.5))), (f"kurt{tag}", F.col(f"{x}4") / F.pow(F.col(f"{x}2"), F.lit(2.0))))]
    out = g.select("strategy", "T", (F.col("end") - 1).alias("cum"), (F.pow("end", per_year / F.col("n")) - 1).alias("ann"), (F.col("sd") * year).alias("vol"), ratio("m_r", "sd").alias("sharpe_period"), (ratio("m_r", "sd") * year).alias("sharpe"), (F.col("m_e") * per_year).alias("ann_excess"), ratio("m_e", "sde").alias("ir_period"), (ratio("m_e", "sde") * year).alias("ir"), "drawdown", *shape)
    return out.join(years, "strategy", "left").withColumns({"years": F.coalesce("years", F.lit(0).cast("long")), "year_hit_rate": F.coalesce("year_hit_rate", F.lit(0.0))})


def deflated_sharpe(ratio, periods, skew, kurt, trial_var, trials):
    """Probability that a ratio beats the best of ``trials`` of no skill, as a column: 1/2 below two periods, null where the
    variance term is not positive."""
    gamma = 0.5772156649  # fixed value: Euler's constant to ten digits
    best = F.sqrt(F.greatest(F.lit(0.0), trial_var)) * ((1 - gamma) * norm_inv(1 - 1 / trials) + gamma * norm_inv(1 - 1 / (trials * F.exp(F.lit(1.0)))))
    spread = 1 - skew * ratio + (kurt - 1) / 4 * ratio * ratio
    z = (ratio - F.when(trials > 1, best).otherwise(0.0)) * F.sqrt(periods - 1.0) / F.sqrt(spread)
    return F.when(periods < 2, F.lit(0.5)).when(spread > 0, norm_cdf(z))


def bootstrap_mean(df: DataFrame, x: str, by: list[str], order: str, block: int = 21, reps: int = 2000, seed: int = 11, level: float = 0.95) -> DataFrame:
    """(by, lo, hi): the interval of the mean over resamples of circular blocks of ``block`` values in ``order``. The start
    of each block is drawn by digest, so that every engine draws alike; block sums are differences of running sums."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.where(F.col(x).isNotNull()).select(*by, (F.row_number().over(w) - 1).alias("i"), F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    size = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max_by("upto", "i").alias("all"))
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "rep", "b")), 1, 8)
    draws = size.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    draws = draws.withColumn("s", F.conv(digest, 16, 10).cast("long") % F.col("n")).withColumn("len", F.least(F.lit(block), F.col("n") - F.col("b") * block))
    # running sums before the start and up to the end, which may be one turn further
    ends = draws.withColumns({"from": F.col("s") - 1, "to": F.col("s") + F.col("len") - 1})
    ends = ends.withColumns({"turns": F.floor(F.col("to") / F.col("n")), "to": F.pmod("to", "n")})
    lo, hi = rows.select(*by, F.col("i").alias("from"), F.col("upto").alias("x0")), rows.select(*by, F.col("i").alias("to"), F.col("upto").alias("x1"))
    keys = [*by]
    sums = ends.join(lo, [*keys, "from"], "left").join(hi, [*keys, "to"])
    means = sums.groupBy(*by, "rep", "n").agg(F.sum(F.col("x1") + F.col("turns") * F.col("all") - F.coalesce("x0", F.lit(0.0))).alias("sum"))
    means = means.select(*by, (F.col("sum") / F.col("n")).alias("m"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("m")) - 1  # ``reps`` rows each
    at = [int(q * (reps - 1) + 1e-9) for q in ((1 - level) / 2, 1 - (1 - level) / 2)]
    ranked = means.withColumn("k", place)
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("k") == a, F.col("m"))).alias(name) for a, name in zip(at, ("lo", "hi"), strict=True)])


def decision_gate(perf: DataFrame, base_drawdown: float, per_year: int, largecap_ok: bool = True) -> DataFrame:
    """(strategy, c1 .. c5, passed, reason): a significant excess, most years won, a deflated ratio above 95 %, no deeper
    fall than the base's and 5 points more, and the large-cap check. ``perf`` is what ``against`` returns, with ci_lo (of the
    mean excess by period) and dsr."""
    c = {
        "c1": (F.col("ann_excess") > 0) & (F.col("ci_lo") * per_year > 0),
        "c2": F.col("year_hit_rate") >= 0.6,
        "c3": F.col("ir_period").isNotNull() & (F.col("dsr") > 0.95),
        "c4": F.col("drawdown") <= base_drawdown + 0.05,
        "c5": F.lit(largecap_ok),
    }
    c = {k: F.coalesce(v, F.lit(False)) for k, v in c.items()}
    rows = perf.select("strategy", *[v.alias(k) for k, v in c.items()])
    passed = F.col("c1") & F.col("c2") & F.col("c3") & F.col("c4") & F.col("c5")
    return rows.withColumn("passed", passed).withColumn("reason", F.concat_ws("; ", *[F.when(~F.col(k), F.lit(k)) for k in c]))


def registry_stats(registry: DataFrame, columns: tuple[str, ...] = ("sharpe_daily", "ir_daily")) -> DataFrame:
    """One row: how many finite values each column of the run registry has, and their sample variance."""
    fine = [F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c)) for c in columns]
    return registry.agg(*[x for c, v in zip(columns, fine, strict=True) for x in (F.count(v).alias(f"n_{c}"), F.var_samp(v).alias(f"var_{c}"))])


def period_returns(curve: DataFrame, dates: DataFrame) -> DataFrame:
    """(strategy, t, r): the return from each decision's close to the next one's, 1 being the value where the curve begins
    in between; null where a close is not on the curve, and for the last decision."""
    d = dates.select("t").distinct().withColumn("next", F.lead("t").over(Window.orderBy("t")))  # a calendar of decisions
    start = curve.groupBy("strategy").agg(F.min("t").alias("first"))
    rows = start.crossJoin(d)
    rows = rows.join(curve.select("strategy", "t", F.col("value").alias("a")), ["strategy", "t"], "left").join(curve.select("strategy", F.col("t").alias("next"), F.col("value").alias("b")), ["strategy", "next"], "left")
    base = F.when((F.col("first") > F.col("t")) & (F.col("first") <= F.col("next")), F.lit(1.0)).otherwise(F.col("a"))
    return rows.select("strategy", "t", F.when(base > 0, F.col("b") / base - 1).alias("r"))


def paired_diff(x: DataFrame, y: DataFrame, years: DataFrame) -> DataFrame:
    """One row (n, mean, t, years_pos, years) of x - y over the dates (t, r) that both have; ``years`` maps t to its year."""
    d = x.select("t", F.col("r").alias("x")).join(y.select("t", F.col("r").alias("y")), "t").where("x is not null and y is not null").join(years, "t").select("year", (F.col("x") - F.col("y")).alias("d"))
    per = d.groupBy("year").agg(F.avg("d").alias("m")).agg(F.count(F.when(F.col("m") > 0, 1)).alias("years_pos"), F.count("*").alias("years"))
    every = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.try_divide(F.avg("d"), F.nullif(F.stddev_samp("d"), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("t"))
    return every.crossJoin(per)  # one row each


def span_of(curve: DataFrame, start, end) -> DataFrame:
    """The part of a curve (strategy, t, value) from ``start`` to ``end``, against its value at the last bar before."""
    before = curve.where(F.col("t") < start).groupBy("strategy").agg(F.max_by("value", "t").alias("base"))
    rows = curve.where((F.col("t") >= start) & (F.col("t") <= end)).join(before, "strategy", "left")
    return rows.select("strategy", "t", (F.col("value") / F.coalesce("base", F.lit(1.0))).alias("value"))


def blend(z: DataFrame, labels: DataFrame, train: int, embargo: int, gate: int, gate_least: int, gate_t: float = 2.0, least: int = 6) -> tuple[DataFrame, DataFrame]:
    """Signals z (step, signal, ticker, z) blended by their past information coefficients against labels (step, ticker,
    label). Returns (step, w_<signal>..., oos_ic, gate_open) and the scores (step, ticker, score, gate_open). The gate opens
    when the out-of-sample coefficients of the ``gate`` steps before the embargo have a t above ``gate_t``."""
    ic = spearman(z.join(labels, ["step", "ticker"]), "z", "label", ["step", "signal"])
    steps = z.select("step").distinct().withColumn("place", F.row_number().over(Window.orderBy("step")))  # a calendar of steps
    grid = steps.crossJoin(z.select("signal").distinct()).join(ic.select("step", "signal", "ic"), ["step", "signal"], "left")
    w = blend_weights(grid.select(F.col("place").alias("step"), "signal", "ic"), train, embargo, least).join(steps.withColumnRenamed("step", "at"), F.col("step") == F.col("place")).select(F.col("at").alias("step"), "place", "signal", "w")
    score = z.join(w.where("w > 0"), ["step", "signal"]).where("z is not null").groupBy("step", "ticker").agg(F.sum(F.col("w") * F.col("z")).alias("score"))
    oos = spearman(score.join(labels, ["step", "ticker"]), "score", "label", ["step"]).select("step", F.col("ic").alias("oos_ic"))
    series = steps.join(oos, "step", "left").join(w.groupBy("step").agg(F.sum("w").alias("any")), "step", "left")
    back = Window.orderBy("place").rowsBetween(-(embargo + gate), -(embargo + 1))
    t = F.try_divide(F.avg("oos_ic").over(back), F.nullif(F.stddev_samp("oos_ic").over(back), F.lit(0.0)) / F.sqrt(F.count("oos_ic").over(back)))
    opened = F.coalesce((F.col("any") > 0) & (F.count("oos_ic").over(back) >= gate_least) & (t > gate_t), F.lit(False))
    series = series.select("step", "oos_ic", opened.alias("gate_open"))
    return series, score.join(series.select("step", "gate_open"), "step")


def greedy_bars(bars: DataFrame, horizon: int, warmup: int, end: int) -> DataFrame:
    """The scored bars (bar_idx) that are taken for a horizon: the first from ``warmup`` on, then each that is at least
    ``horizon`` after the last one taken, as long as the label ends before ``end``."""

    def run(batches):
        import pandas as pd

        last = None
        for b in batches:
            taken = []
            for t in b["bar_idx"].tolist():
                if last is None or t >= last + horizon:
                    taken.append(t)
                    last = t
            yield pd.DataFrame({"bar_idx": taken})

    fine = bars.select(F.col("bar_idx").cast("int").alias("bar_idx")).distinct().where((F.col("bar_idx") >= warmup) & (F.col("bar_idx") + 1 + horizon < end))
    return fine.coalesce(1).sortWithinPartitions("bar_idx").mapInPandas(run, "bar_idx int")  # a calendar: one number a bar


def ic_table(scores: DataFrame, grid: DataFrame, eligible: DataFrame, horizons: tuple[int, ...], warmup: int, end: int) -> DataFrame:
    """(signal, horizon, n, mean, t): coefficients of scores (bar_idx, signal, ticker, x) against forward returns on the
    dense grid, on every horizon-th bar from ``warmup`` on, over the eligible (bar_idx, ticker) names."""
    out = None
    own = scores.join(eligible.select("bar_idx", "ticker"), ["bar_idx", "ticker"])
    for h in horizons:
        near = forward_return(grid, h).select("bar_idx", "ticker", "fwd").where(((F.col("bar_idx") - warmup) % h == 0) & (F.col("bar_idx") >= warmup) & (F.col("bar_idx") + 1 + h < end))
        ic = spearman(own.join(near, ["bar_idx", "ticker"]), "x", "fwd", ["bar_idx", "signal"])
        rows = mean_t(ic.where("ic is not null"), "ic", ["signal"]).withColumn("horizon", F.lit(h))
        out = rows if out is None else out.unionByName(rows)
    return out.select("signal", "horizon", "n", "mean", "t")


def cut(df: DataFrame) -> DataFrame:
    """``df`` without the plan it came from: a checkpoint in the shared folder that ``spark.checkpoint.dir`` names. Where that
    is unset, a temporary folder will do in local mode, and nothing else."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ebbflow-"))
    return df.checkpoint()


def study(bars: DataFrame, params, unit: str = "month", warmup: int = 12, floor: float = 0.0, top_n: int = 1 << 30, window: int = 20, horizons: tuple[int, ...] = (1, 2, 5), train: int = 24, embargo: int = 1, gate: int = 12, gate_least: int = 6, gate_t: float = 2.0, tilt: float = 0.2, k: int = 10, cap: float = 0.1, cost_bps: float = 10.0, turnover_cap: float = 0.5) -> dict[str, DataFrame]:
    """The whole walk-forward study over bars, causal throughout: ``ic`` (the coefficients of every signal and horizon),
    ``steps`` (out-of-sample coefficient and gate of each rebalance), ``targets`` and ``curves`` (of the gated blend, every
    signal's tilt over the equal-weight base, and the standing benchmarks).

    A decision is taken at the close of a rebalance bar on nodes that are eligible and active, and executed at the next
    open; its label runs from that open to the one after the next decision."""
    from ..sources import tables
    from . import frames
    from .panel import eligible, rebalance_dates
    from .stats import zscore

    end = (bars.agg(F.max("bar_idx")).first()[0] or 0) + 1
    grid = cut(tables.dense(bars))
    raw = frames.signals(cut(frames.frames(bars, params))).withColumnRenamed("node", "ticker")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("x")) for c in frames.SIGNALS]))
    scores = cut(raw.select("bar_idx", "ticker", pairs.alias("y")).select("bar_idx", "ticker", "y.signal", "y.x").where("x is not null"))
    names = cut(eligible(grid, window, floor, top_n).select("bar_idx", "ticker"))
    dates = cut(rebalance_dates(bars, unit, max(warmup, 1)).select(F.col("bar_idx").cast("int").alias("bar_idx")))
    table = ic_table(scores, grid, names, horizons, max(warmup, 1), end)

    z = cut(zscore(scores.join(dates, "bar_idx").join(names, ["bar_idx", "ticker"]), "x", ["bar_idx", "signal"]).select(F.col("bar_idx").alias("step"), "signal", "ticker", "z"))
    following = dates.withColumn("next", F.lead("bar_idx").over(Window.orderBy("bar_idx")))  # a calendar
    opens = grid.select("bar_idx", "ticker", "o")
    a = following.select(F.col("bar_idx").alias("step"), (F.col("bar_idx") + 1).alias("bar_idx")).join(opens, "bar_idx").select("step", "ticker", F.col("o").alias("o1"))
    b = following.where("next is not null").select(F.col("bar_idx").alias("step"), (F.col("next") + 1).alias("bar_idx")).join(opens, "bar_idx").select("step", "ticker", F.col("o").alias("o2"))
    labels = cut(a.join(b, ["step", "ticker"]).where("o1 > 0").select("step", "ticker", (F.col("o2") / F.col("o1") - 1).alias("label")))
    steps, blended = (cut(x) for x in blend(z, labels, train, embargo, gate, gate_least, gate_t))

    universe = bars.select("ticker").distinct()
    base = universe.crossJoin(universe.agg((1 / F.count("*")).alias("w")))  # one row
    closed = steps.where(~F.col("gate_open")).select("step").crossJoin(base).select(F.lit("blend").alias("strategy"), "step", "ticker", "w")  # a closed gate holds the base
    own = blended.where("gate_open").select(F.lit("blend").alias("strategy"), "step", "ticker", "score").unionByName(z.select(F.concat(F.lit("sig:"), "signal").alias("strategy"), "step", "ticker", F.col("z").alias("score")))
    targets = target_weights(own, base, tilt, k, cap, ("strategy",))
    targets = targets.unionByName(closed).withColumnRenamed("step", "t")
    standing = benchmarks(dates.select(F.col("bar_idx").alias("t")), base, names.withColumnRenamed("bar_idx", "t"))
    targets = targets.unionByName(standing.select(F.concat(F.lit("bench:"), "strategy").alias("strategy"), F.col("t").cast("int").alias("t"), "ticker", "w"))
    prices = grid.select(F.col("bar_idx").alias("t"), "ticker", "o", "c")
    return {"ic": table, "steps": steps, "targets": targets, "curves": simulate(prices, targets, cost_bps, turnover_cap)}
