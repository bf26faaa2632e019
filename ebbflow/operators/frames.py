"""The model bar by bar: active nodes, slow and fast flow graphs, where money concentrates on each bar, what comes next.

A frame is one bar's state of all active nodes. Every bar's graph is folded from the flows up to it (each source's row on
its own), and every bar is solved on its own: a stationary distribution does not depend on where the solver starts, so
bars need no order among each other and run in parallel.

Without a tilt every source pays the same sinks of a bar, so a bar's flows are an outer product and the panel of pressures
holds them all. Where nothing cuts them before they are pruned (``from_panel``), they are formed block by block in the task
that solves the bar and never leave it; else they are made, folded and pruned as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params
from ..sources import tables
from . import flux, panel

KINDS = ("slow", "fast", "long")
#: Bars that one task solves from the panel, and entries of the matrix it forms at a time.
RUN, CELLS = 6, 2_000_000


def activity(bars: DataFrame, params: Params) -> DataFrame:
    """(bar_idx, ticker, active, mdv, p) of every ticker on every bar: the causal mask, the carried median dollar volume
    and the pressure, which is 0 for inactive nodes."""
    rets = panel.returns(bars)
    if params.pressure == "relative":
        rets = panel.adv(rets, params.adv_window)
    p = panel.pressure(rets, params.pressure, params.volume_cap).select("bar_idx", "ticker", "p")
    grid = panel.active_mask(tables.dense(panel.median_dollar_volume(bars, params.adv_window)), params.liquidity_floor, params.stale_bars)
    by = Window.partitionBy("ticker").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.select("bar_idx", "ticker", "active", F.last("mdv", ignorenulls=True).over(by).alias("mdv"))
    rows = grid.join(p, ["bar_idx", "ticker"], "left")
    return rows.select("bar_idx", "ticker", "active", "mdv", F.when(F.col("active"), F.coalesce("p", F.lit(0.0))).otherwise(0.0).alias("p"))


def shocked(state: DataFrame, shocks: DataFrame, bar: int, mode: str) -> DataFrame:
    """``state`` with an extra return of ``size`` per cent, at normal volume, on the nodes of ``shocks`` (ticker, size) on
    ``bar``; sizes of one node add up. Nodes that are inactive or without normal volume are left as they are."""
    extra = shocks.groupBy("ticker").agg(F.sum("size").alias("size"))
    volume = {"dollar": F.col("mdv"), "sqrt": F.sqrt("mdv")}.get(mode, F.lit(1.0))
    push = F.when((F.col("bar_idx") == bar) & F.col("active") & (F.col("mdv") > 0), F.col("size") / 100 * volume).otherwise(0.0)
    return state.join(F.broadcast(extra), "ticker", "left").withColumn("p", F.col("p") + F.coalesce(push, F.lit(0.0))).drop("size")


def fold(flows: DataFrame, end: int, half_lives: dict[str, float], cap: int, since: int = 0) -> DataFrame:
    """(bar_idx, src, dst, kind, w): the flows up to each bar from ``since`` on, halved every ``half_lives[kind]`` bars. A row is cut to its
    ``cap`` largest entries and loses those below 1e-12 of its peak (0: neither). A source's row depends on its own flows alone."""

    def run(pdf):
        import pandas as pd

        dst, col = np.unique(pdf["dst"].to_numpy(), return_inverse=True)
        first = int(pdf["bar_idx"].min())
        add = np.zeros((end + 1 - first, len(dst)))
        np.add.at(add, (pdf["bar_idx"].to_numpy() - first, col), pdf["w"].to_numpy())
        out = []
        for kind, half_life in half_lives.items():
            now, decay, peak = np.zeros(len(dst)), 2.0 ** (-1.0 / half_life), 0.0
            for t in range(len(add)):
                now = now * decay + add[t]
                if cap and add[t].any():
                    if np.count_nonzero(now) > cap:
                        now[np.lexsort((dst, -now))[cap:]] = 0.0
                    peak = now.max()
                    now[now < 1e-12 * peak] = 0.0
                if first + t >= since:
                    some = np.flatnonzero(now > 0)
                    out.append(pd.DataFrame({"bar_idx": first + t, "src": pdf["src"].iloc[0], "dst": dst[some], "kind": kind, "w": now[some]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["bar_idx", "src", "dst", "kind", "w"])

    return flows.where(F.col("bar_idx") <= end).groupBy("src").applyInPandas(run, "bar_idx int, src long, dst long, kind string, w double")


def margins(state: DataFrame, end: int, half_life: float, since: int = 0) -> DataFrame:
    """(bar_idx, node, outflow, inflow), decayed like the slow graph and exact over all pairs."""
    m = flux.margins(state.select("bar_idx", "ticker", "p"))
    return flux.accumulate_series(m, ["outflow", "inflow"], end, half_life, since)


def transitions(edges: DataFrame, state: DataFrame, params: Params, margin: DataFrame | None = None) -> DataFrame:
    """(bar_idx, kind, src, dst, p): edges between nodes active on the bar, pruned to the union of the largest of each
    source and sink; rows sum to 1, with retention on the diagonal, and dead ends with themselves where they do not
    teleport. ``margin`` (bar_idx, node, outflow, inflow) is needed for a lift or retention."""
    alive = state.where("active").select("bar_idx", F.col("ticker").alias("node"))
    e = edges.where("src <> dst and w > 0")
    e = e.join(alive.withColumnRenamed("node", "src"), ["bar_idx", "src"]).join(alive.withColumnRenamed("node", "dst"), ["bar_idx", "dst"])
    if params.lift != "off":
        total = margin.groupBy("bar_idx").agg(F.sum("outflow").alias("total"))
        e = e.join(margin.select("bar_idx", F.col("node").alias("src"), "outflow"), ["bar_idx", "src"]).join(margin.select("bar_idx", F.col("node").alias("dst"), "inflow"), ["bar_idx", "dst"]).join(total, "bar_idx")
        expected = F.col("outflow") * F.col("inflow") / F.col("total")
        e = e.withColumn("w", F.col("w") - expected if params.lift == "excess" else F.try_divide("w", expected) - 1).where("w > 0")
    rows = flux.union_top(e.select("bar_idx", "kind", "src", "dst", "w"), params.k_out, params.k_in, ["bar_idx", "kind"])
    rows = rows.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("bar_idx", "kind", "src"))).drop("w")
    if params.retention > 0:
        own = margin.select("bar_idx", F.col("node").alias("src"), F.try_divide(params.retention * F.col("inflow"), F.col("outflow") + params.retention * F.col("inflow")).alias("self"))
        rows = rows.join(own, ["bar_idx", "src"], "left").withColumn("self", F.coalesce("self", F.lit(0.0)))
        loops = rows.where("self > 0").select("bar_idx", "kind", "src", F.col("src").alias("dst"), F.col("self").alias("p")).distinct()
        rows = rows.withColumn("p", F.col("p") * (1 - F.col("self"))).drop("self").unionByName(loops)
    if params.dangling == "self":
        kinds = edges.select("kind").distinct()
        every = alive.crossJoin(kinds).withColumnRenamed("node", "src")  # a few kinds
        dead = every.join(rows.select("bar_idx", "kind", "src").distinct(), ["bar_idx", "kind", "src"], "left_anti")
        rows = rows.unionByName(dead.select("bar_idx", "kind", "src", F.col("src").alias("dst"), F.lit(1.0).alias("p")))
    return rows


class Whole:
    """The graph of all flows among the tickers ``alive`` after the last bar of ``p`` (bars x tickers), of which each bar's
    sinks took ``bought`` in all; rows sum to 1. It is a sum of outer products, one for each bar, and is kept as that: no
    edge is formed, and the distribution is found from what each bar's sinks receive, a number for each bar."""

    def __init__(self, p: np.ndarray, bought: np.ndarray, alive: np.ndarray, half_life: float):
        self.p, self.bought, self.alive = p, bought[:, None], alive
        self.decay = 2.0 ** (-(len(p) - 1 - np.arange(len(p))) / half_life)
        reach = sum((share.sum(1) for _, _, share in self.parts()), np.zeros(len(p)))  # 1 where all sinks are alive
        self.out = np.zeros(len(alive))
        for at, sold, _ in self.parts():
            self.out[at] = (self.decay * reach) @ sold
        self.dead, self.reach = self.out <= 0, reach

    def parts(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        step = max(1, CELLS // len(self.p))
        for lo in range(0, len(self.alive), step):
            x = self.p[:, self.alive[lo : lo + step]]
            yield slice(lo, lo + step), np.maximum(-x, 0.0), np.maximum(x, 0.0) / self.bought

    def flow(self, pi: np.ndarray) -> np.ndarray:
        rate, new = np.divide(pi, self.out, out=np.zeros(len(pi)), where=~self.dead), np.empty(len(pi))
        taken = self.decay * sum(sold @ rate[at] for at, sold, _ in self.parts())
        for at, _, share in self.parts():
            new[at] = taken @ share
        return new

    def settle(self, alpha: float, tol: float, most: int) -> np.ndarray:
        n, bars = len(self.alive), len(self.p)
        passed, even, lost = np.zeros((bars, bars)), np.zeros(bars), np.zeros(bars)
        rate = np.divide(1.0, self.out, out=np.zeros(n), where=~self.dead)
        for at, sold, share in self.parts():
            sold = sold * rate[at] * self.decay[:, None]
            passed += sold @ share.T  # what a bar's sinks receive of what those of another hold
            even += sold.sum(1)
            lost += share[:, self.dead[at]].sum(1)
        dead = self.dead.sum()
        taken, idle = even / n, dead / n  # of an even spread: what each bar's sinks receive, and what dead ends hold
        for _ in range(most):
            now = alpha * (passed @ taken + idle / n * even) + (1 - alpha) / n * even
            held = alpha * (lost @ taken + idle * dead / n) + (1 - alpha) * dead / n
            change, taken, idle = np.abs(now - taken) @ self.reach + abs(held - idle), now, held
            if change < tol:
                break
        pi = np.empty(n)
        for at, _, share in self.parts():
            pi[at] = alpha * (taken @ share + idle / n) + (1 - alpha) / n
        return pi / pi.sum()


def damped(pi: np.ndarray, graph: Whole | tuple, alpha: float) -> np.ndarray:
    n = len(pi)
    if isinstance(graph, Whole):
        flow, dead = graph.flow(pi), graph.dead
    else:
        s, d, w = graph
        flow, dead = np.bincount(d, weights=pi[s] * w, minlength=n), np.bincount(s, minlength=n) == 0
    new = alpha * (flow + pi[dead].sum() / n) + (1 - alpha) / n
    return new / new.sum()


def settled(n: int, graphs: dict, params: Params, tol: float = 1e-13, most: int = 1000) -> dict:
    """pi, pi_long, floor, pi_1, ... of one bar from its graphs (src, dst, p as arrays, or whole) by kind."""

    def settle(g):
        if isinstance(g, Whole):
            return g.settle(params.alpha, tol, most)
        pi = np.full(n, 1 / n)
        for _ in range(most):
            new = damped(pi, g, params.alpha)
            change, pi = np.abs(new - pi).sum(), new
            if change < tol:
                break
        return pi

    pi = settle(graphs["slow"])
    slow = graphs["slow"]
    dead = slow.dead if isinstance(slow, Whole) else np.bincount(slow[0], minlength=n) == 0
    floor = ((1 - params.alpha) + params.alpha * pi[dead].sum()) / n
    out = {"pi": pi, "pi_long": settle(graphs["long"]) if "long" in graphs else np.nan, "floor": floor}
    ahead = pi
    for k in range(1, max(params.horizons) + 1):
        ahead = damped(ahead, graphs["fast"], params.alpha)
        if k in params.horizons:
            out[f"pi_{k}"] = ahead
    return out


def solve(state: DataFrame, rows: DataFrame, params: Params, tol: float = 1e-13, most: int = 1000) -> DataFrame:
    """(bar_idx, node, n, pi, pi_long, floor, pi_1, pi_4, ...): the stationary distribution of each bar's slow graph (and
    long one, if there), its teleport floor, and where the fast graph carries it in each horizon. A group is one bar's
    pruned graph: at most (k_out + k_in) edges for each node."""
    def run(nodes, edges):
        import pandas as pd

        names = np.sort(nodes["node"].to_numpy())

        def graph(kind):
            e = edges[edges["kind"] == kind]
            return np.searchsorted(names, e["src"]), np.searchsorted(names, e["dst"]), e["p"].to_numpy()

        found = settled(len(names), {k: graph(k) for k in KINDS if k != "long" or (edges["kind"] == "long").any()}, params, tol, most)
        return pd.DataFrame({"bar_idx": nodes["bar_idx"].iloc[0], "node": names, "n": len(names), **found})

    alive = state.where("active").select("bar_idx", F.col("ticker").alias("node"))
    kind = "bar_idx int, node long, n long, pi double, pi_long double, floor double, " + ", ".join(f"pi_{k} double" for k in sorted(params.horizons))
    return alive.groupBy("bar_idx").cogroup(rows.groupBy("bar_idx")).applyInPandas(run, kind)


def from_panel(params: Params) -> bool:
    return params.tilt == 0 and params.lift == "off" and params.retention == 0 and params.row_cap == 0


def best_of_rows(e: np.ndarray, k: int) -> np.ndarray:
    """Mask of the ``k`` largest positive entries of each row, ties to the lower column."""
    if e.shape[1] <= k:
        return e > 0
    edge = np.partition(e, e.shape[1] - k, axis=1)[:, e.shape[1] - k, None]
    mask, ties = e > edge, e == edge
    left = k - mask.sum(1)
    over = np.flatnonzero(ties.sum(1) > left)
    ties[over] &= np.cumsum(ties[over], axis=1, dtype=np.int32) <= left[over, None]
    mask |= ties
    return mask & (e > 0)


def best_of_columns(col: np.ndarray, src: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest entries of each column, ties to the lower source."""
    order = np.lexsort((src, -w, col))
    c = col[order]
    return order[np.arange(len(c)) - np.searchsorted(c, c) < k]


def pruned(p: np.ndarray, sinks: list, alive: np.ndarray, half_life: float, k_out: int, k_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, p) as places in ``alive``: the graph after the last bar of ``p`` (bars x tickers) among the tickers
    ``alive``. ``sinks`` has each bar's sinks and what share of every outflow they take. Every entry is formed, a block of
    sources at a time, and of a block the best of its rows and those that may be among the best of their columns stay."""
    place = np.full(p.shape[1], -1)
    place[alive] = np.arange(len(alive))
    cols = np.unique(np.concatenate([s for s, _ in sinks])) if sinks else np.zeros(0, np.int64)
    cols = cols[place[cols] >= 0]
    src = alive[(p[:, alive] < 0).any(0)]
    if not len(cols) or not len(src):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pays = []
    for b, (s, share) in enumerate(sinks):
        known = place[s] >= 0
        if known.any():
            pays.append((b, np.searchsorted(cols, s[known]), (share[known] * 2.0 ** (-(len(sinks) - 1 - b) / half_life))[:, None]))
    rows, tops, least = [], [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], np.zeros(len(cols))
    step = max(1, CELLS // len(cols))
    for lo in range(0, len(src), step):
        block = src[lo : lo + step]
        e = np.zeros((len(cols), len(block)))
        for b, at, share in pays:
            e[at] += share * np.maximum(-p[b, block], 0.0)
        at = np.searchsorted(cols, block)
        own = np.flatnonzero(cols[np.minimum(at, len(cols) - 1)] == block)
        e[at[own], own] = 0.0
        e = np.ascontiguousarray(e.T)
        r, c = np.nonzero(best_of_rows(e, k_out))
        rows.append((block[r], c, e[r, c]))
        if k_in:
            if not lo and len(block) > k_in:  # later blocks are held against what was found
                least = np.nextafter(np.partition(e, len(block) - k_in, axis=0)[len(block) - k_in], -1.0)
            r, c = np.nonzero(e > np.maximum(least, 0.0))
            tops = [np.concatenate(x) for x in zip(tops, (block[r], c, e[r, c]), strict=True)]
            keep = best_of_columns(tops[1], tops[0], tops[2], k_in)
            tops = [x[keep] for x in tops]
            full = np.bincount(tops[1], minlength=len(cols)) >= k_in
            least = np.full(len(cols), np.inf)
            np.minimum.at(least, tops[1], tops[2])
            least = np.where(full, least, 0.0)
    s, c, w = (np.concatenate(x) for x in zip(*rows, tops, strict=True))
    _, once = np.unique(s * len(cols) + c, return_index=True)
    s, d, w = place[s[once]], place[cols[c[once]]], w[once]
    return s, d, w / np.bincount(s, weights=w, minlength=len(alive))[s]


def run_frames(ticker: np.ndarray, p: np.ndarray, active: np.ndarray, mdv: np.ndarray, lo: int, half_lives: dict[str, float], params: Params) -> Iterator[dict]:
    """Columns of the frames of the bars ``lo`` to ``len(p)``. ``p`` (bars from 1 x tickers in order) is the panel up to
    there; ``active`` and ``mdv`` are its last bars, from the one before ``lo`` on."""
    hi, first = len(p), len(p) + 1 - len(active)
    sinks, bought, flows, decay = [], np.ones(hi), np.zeros((2, len(ticker))), 2.0 ** (-1.0 / params.half_life_slow)
    before = np.full(len(ticker), np.nan)
    n_before = None
    for t in range(1, hi + 1):
        x = p[t - 1]
        up, flows = np.flatnonzero(x > 0), flows * decay
        buy, sell = x[up].sum(), -x[x < 0].sum()
        if len(up):
            flows += np.maximum(x, 0.0) * sell / buy, np.maximum(-x, 0.0)
            bought[t - 1] = buy
        if not params.whole:
            top = up[np.lexsort((up, -x[up]))][: params.row_edges]
            sinks.append((top, x[top] / buy if len(up) else x[top]))
        if t < first:
            continue
        alive = np.flatnonzero(active[t - first])
        n = len(alive)
        if not n:
            before, n_before = np.full(len(ticker), np.nan), None
            continue
        graphs = {}
        for kind, half_life in half_lives.items():
            if params.whole:
                graphs[kind] = Whole(p[:t], bought[:t], alive, half_life)
                continue
            s, d, w = pruned(p[:t], sinks, alive, half_life, params.k_out, params.k_in)
            if params.dangling == "self":
                dead = np.setdiff1d(np.arange(n), s)
                s, d, w = np.concatenate([s, dead]), np.concatenate([d, dead]), np.concatenate([w, np.ones(len(dead))])
            graphs[kind] = s, d, w
        found = settled(n, graphs, params)
        if t >= lo:
            was = before[alive]
            yield {
                "bar_idx": t, "node": ticker[alive], "n": n, **found, "size_ref": mdv[t - first][alive], "inflow": flows[0][alive], "outflow": flows[1][alive],
                "pi_before": was, "n_before": n_before, "carried": np.nansum(was),
            }
        before, n_before = np.full(len(ticker), np.nan), n
        before[alive] = found["pi"]


def solve_panel(state: DataFrame, end: int, half_lives: dict[str, float], params: Params, since: int = 1) -> DataFrame:
    """(bar_idx, node, n, pi, pi_long, floor, pi_1, ..., size_ref, inflow, outflow, pi_before, n_before, carried) of the
    bars from ``since`` on, from the dense ``state`` of the bars from 1 to ``end``. A group is ``RUN`` bars and holds
    the pressures up to them, a number for each ticker and bar; what is shuffled is that panel, once for each group."""
    runs = [(lo, min(lo + RUN - 1, end)) for lo in range(max(since, 1), end + 1, RUN)]
    many = ["pi", "pi_long", "floor", *[f"pi_{k}" for k in sorted(params.horizons)], "size_ref", "inflow", "outflow", "pi_before"]
    kind = "bar_idx int, node long, n long, " + ", ".join(f"{c} double" for c in many) + ", n_before long, carried double"
    names = [c.split()[0] for c in kind.split(", ")]

    def run(key, table):
        import pyarrow as pa

        whole = {"bar_idx": pa.int32(), "node": pa.int64(), "n": pa.int64(), "n_before": pa.int64()}
        schema = pa.schema([(c, whole.get(c, pa.float64())) for c in names])
        (lo, hi), rows = runs[key[0].as_py()], table.num_rows
        ticker = table.column("ticker").to_numpy()
        order = np.argsort(ticker)

        def bars(name, width):
            flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return np.ascontiguousarray(flat.reshape(rows, width)[order].T)

        near = hi + 1 - max(lo - 1, 1)
        found = [pa.RecordBatch.from_pylist([], schema)]
        for f in run_frames(ticker[order], bars("p", hi), bars("active", near), bars("mdv", near), lo, half_lives, params):
            m = len(f["node"])
            full = [v if isinstance(v, np.ndarray) else [v] * m for v in map(f.get, names)]
            found.append(pa.RecordBatch.from_arrays([pa.array(v, k, from_pandas=True) for v, k in zip(full, schema.types, strict=True)], schema=schema))
        return pa.Table.from_batches(found)

    rows = state.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("bar_idx", "p", "active", "mdv"))).alias("s"))  # a struct for each bar
    spans = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(b).alias("hi"), F.lit(max(a - 1, 1)).alias("at")) for i, (a, b) in enumerate(runs)])
    rows = rows.select("ticker", "s", F.explode(spans).alias("x"))
    near = F.slice("s", F.col("x.at"), F.col("x.hi") - F.col("x.at") + 1)
    rows = rows.select("x.run", "ticker", F.slice("s", F.lit(1), F.col("x.hi")).p.alias("p"), near.active.alias("active"), near.mdv.alias("mdv"))
    # a partition for each run: little data, much work
    return rows.repartitionById(len(runs), "run").groupBy("run").applyInArrow(run, kind)


def solve_rows(state: DataFrame, flows: DataFrame, end: int, half_lives: dict[str, float], params: Params, since: int) -> DataFrame:
    """What ``solve_panel`` returns, from flows as rows, which a tilt, a lift, a cap or retention ask for."""
    margin, near = margins(state, end, params.half_life_slow, since), state.where(F.col("bar_idx") >= since)
    edges = fold(flows, end, half_lives, params.row_cap, since)
    solved = solve(near, transitions(edges, near, params, margin), params).persist()  # read for each bar and for the one after
    m = margin.select("bar_idx", "node", "outflow", "inflow")
    size = near.select("bar_idx", F.col("ticker").alias("node"), F.col("mdv").alias("size_ref"))
    f = solved.join(size, ["bar_idx", "node"]).join(m, ["bar_idx", "node"], "left")
    before = solved.select((F.col("bar_idx") + 1).alias("bar_idx"), "node", F.col("pi").alias("pi_before"), F.col("n").alias("n_before"))
    f = f.join(before, ["bar_idx", "node"], "left")
    return f.withColumn("carried", F.sum("pi_before").over(Window.partitionBy("bar_idx")))


def frames(bars: DataFrame, params: Params, last_only: bool = False, shocks: DataFrame | None = None, near: int | None = None) -> DataFrame:
    """One row for each active node and bar (the last bar alone, or the ``near`` last ones): bar_idx, node, n, pi, score, h,
    inflow, size_ref, floor, pulse and forecast_k for each horizon. Bars start at 1."""
    end = bars.agg(F.max("bar_idx")).first()[0] or 0
    state = activity(bars, params).where("bar_idx >= 1")
    if shocks is not None:
        state = shocked(state, shocks, end, params.pressure)
    half_lives = {"slow": params.half_life_slow, "fast": params.half_life_fast} | ({"long": params.half_life_long} if params.hot_ref == "longrun" else {})
    near = 1 if last_only else near
    since = max(end + 1 - near, 1) if near else 1
    if from_panel(params) and end >= 1:
        f = solve_panel(state, end, half_lives, params, since)
        f = f.persist() if near else f  # a few bars, read more than once
    else:
        state = state.persist()  # a row for each node and bar
        p = state.where("p <> 0").select("bar_idx", "ticker", "p")
        flows = flux.tilted_flux(p, panel.returns(bars), params.corr_window, params.tilt, params.sinks, params.row_edges, 0) if params.tilt > 0 else flux.bar_flux(p, params.sinks, params.row_edges)
        f = solve_rows(state, flows, end, half_lives, params, max(since - 1, 0)).where(F.col("bar_idx") >= since)
    f = heat(f.withColumn("score", F.col("pi") * F.col("n")), params.hot_ref)
    f = f.withColumn("pulse", F.ln("score") - F.ln(F.col("pi_before") * F.col("n_before")))
    drift = F.when(F.col("carried") > 0, params.beta * F.col("n") * (F.col("pi") - F.coalesce("pi_before", F.lit(0.0)) / F.col("carried"))).otherwise(0.0)
    f = f.withColumns({f"forecast_{k}": F.col("n") * (F.col(f"pi_{k}") - F.col("pi")) + drift for k in params.horizons})
    return f.select("bar_idx", "node", "n", "pi", "score", "h", F.coalesce("inflow", F.lit(0.0)).alias("inflow"), "size_ref", "floor", "pulse", *[f"forecast_{k}" for k in params.horizons])


def heat(f: DataFrame, reference: str) -> DataFrame:
    """``h``: pi against an even spread, the share of size, the long run, or net flow. A missing size is the upper median."""
    bar = Window.partitionBy("bar_idx")
    if reference == "uniform":
        return f.withColumn("h", F.col("score") - 1)
    if reference == "netflow":
        both = F.coalesce(F.col("inflow") + F.col("outflow"), F.lit(0.0))
        mid = f.groupBy("bar_idx").agg(F.percentile(both, F.lit(0.5)).alias("mid"))
        return f.join(mid, "bar_idx").withColumn("h", F.coalesce(F.try_divide(F.col("inflow") - F.col("outflow"), both + F.col("mid")), F.lit(0.0))).drop("mid")
    if reference == "longrun":
        return f.withColumn("h", F.col("pi") / F.greatest("pi_long", F.lit(1e-12)) - 1)
    known = F.sort_array(F.collect_list(F.when(F.col("size_ref") > 0, F.col("size_ref"))))  # one number for each node of a bar
    mid = f.groupBy("bar_idx").agg(known.alias("known")).select("bar_idx", F.get("known", F.floor(F.size("known") / 2).cast("int")).alias("mid"))
    rows = f.join(mid, "bar_idx").withColumn("ref", F.when(F.col("size_ref") > 0, F.col("size_ref")).otherwise(F.col("mid")))
    share = F.col("ref") / F.sum("ref").over(bar)
    return rows.withColumn("h", F.col("pi") / F.greatest(share, F.lit(1e-12)) - 1).drop("ref", "mid")


def earlier(c: str, k: int):
    """The value of ``c`` exactly ``k`` bars before, null where the node has no frame there; no frame is read twice."""
    return F.max(c).over(Window.partitionBy("node").orderBy("bar_idx").rangeBetween(-k, -k))


def signals(f: DataFrame) -> DataFrame:
    """(bar_idx, node, score, pulse1, pulse5, pulse20, pi_rel_size, neg_hotness, inflow_mom5, forecast) of every frame row;
    a difference is null where the node has no frame that many bars before."""
    out = f.withColumn("log", F.ln("score"))
    out = out.withColumns({f"log_{k}": earlier("log", k) for k in (1, 5, 20)} | {"inflow_5": earlier("inflow", 5)})
    share = F.col("size_ref") / F.sum(F.when(F.col("size_ref") > 0, F.col("size_ref"))).over(Window.partitionBy("bar_idx"))
    momentum = F.when((F.col("inflow") > 0) & (F.col("inflow_5") > 0), F.ln(F.col("inflow") / F.col("inflow_5")))
    first = next(c for c in f.columns if c.startswith("forecast_"))
    return out.select(
        "bar_idx", "node", F.col("log").alias("score"), *[(F.col("log") - F.col(f"log_{k}")).alias(f"pulse{k}") for k in (1, 5, 20)],
        F.when((share > 0) & (F.col("pi") > 0), F.ln(F.col("pi") / share)).alias("pi_rel_size"), (-F.col("h")).alias("neg_hotness"), momentum.alias("inflow_mom5"), F.col(first).alias("forecast"),
    )


SIGNALS = ("score", "pulse1", "pulse5", "pulse20", "pi_rel_size", "neg_hotness", "inflow_mom5", "forecast")


def path(f: DataFrame, lag: int = 5) -> DataFrame:
    """(bar_idx, node, mr, momentum): each node's score and the change of its logarithm over ``lag`` bars."""
    f = f.withColumn("log", F.ln("score"))
    return f.select("bar_idx", "node", F.col("score").alias("mr"), (F.col("log") - earlier("log", lag)).alias("momentum"))


def top(f: DataFrame, n: int, bars: int, by: str = "pi", digits: int = 12) -> DataFrame:
    """(rank, node, prev_rank, score, h, pulse, series): the ``n`` best of the last bar, their rank on the bar before and
    their metric on the last ``bars`` bars, oldest first, null where they had no frame."""
    f = f.withColumn("metric", F.col("score") if by == "pi" else F.col("h"))
    end = f.agg(F.max("bar_idx").alias("end"))
    place = F.row_number().over(Window.partitionBy("bar_idx").orderBy(F.desc(F.round(by, digits)), "node"))
    near = f.crossJoin(end).where(F.col("bar_idx") > F.col("end") - bars)  # one row
    ranked = near.where(F.col("bar_idx") >= F.col("end") - 1).withColumn("rank", place)
    now = ranked.where((F.col("bar_idx") == F.col("end")) & (F.col("rank") <= n))
    was = ranked.where(F.col("bar_idx") == F.col("end") - 1).select("node", F.col("rank").alias("prev_rank"))
    held = near.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct((F.col("bar_idx") - F.col("end") + bars - 1).alias("at"), "metric"))).alias("held"))  # ``bars`` at most
    rows = now.join(was, "node", "left").join(held, "node")
    series = F.transform(F.sequence(F.lit(0), F.lit(bars - 1)), lambda i: F.try_element_at("held", i))
    return rows.select("rank", "node", "prev_rank", "score", "h", "pulse", series.alias("series"))


def bottom(f: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The worst ``n`` rows of the last bar that are above the teleport floor, and one row (floor_count, floor_score) of
    those on it."""
    end = f.agg(F.max("bar_idx").alias("end"))
    last = f.join(end, f.bar_idx == end.end, "left_semi")
    at = F.col("pi") <= F.col("floor") * (1 + 1e-6)
    worst = last.where(~at).orderBy(F.round("pi", 12), F.desc("node")).limit(n)
    return worst, last.agg(F.count(F.when(at, 1)).alias("floor_count"), F.max(F.col("floor") * F.col("n")).alias("floor_score"))


def shock_response(bars: DataFrame, params: Params, shocks: DataFrame) -> DataFrame:
    """(node, dh, dpi, dscore) of the last bar, with the shocks against without; ``dscore`` of the first horizon."""
    first = f"forecast_{params.horizons[0]}"
    base, other = (frames(bars, params, True, s).select("node", "h", "pi", F.col(first).alias("fc")) for s in (None, shocks))
    other = other.withColumnsRenamed({"h": "h2", "pi": "pi2", "fc": "fc2"})
    return base.join(other, "node").select("node", (F.col("h2") - F.col("h")).alias("dh"), (F.col("pi2") - F.col("pi")).alias("dpi"), (F.col("fc2") - F.col("fc")).alias("dscore"))


def receivers(response: DataFrame, shocks: DataFrame, n: int = 15, digits: int = 9) -> DataFrame:
    """(side, place, node, dh): who gains and who loses most, the shocked nodes left out."""
    others = response.join(shocks.select(F.col("ticker").alias("node")).distinct(), "node", "left_anti").withColumn("key", F.round("dh", digits))
    gain = others.orderBy(F.desc("key"), "node").limit(n).withColumns({"side": F.lit("receiver"), "place": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("key"), "node"))})
    loss = others.orderBy("key", F.desc("node")).limit(n).withColumns({"side": F.lit("loser"), "place": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key", F.desc("node")))})  # n rows each
    return gain.unionByName(loss).select("side", "place", "node", "dh")


def carry(before: DataFrame, state: DataFrame) -> DataFrame:
    """(node, pi): the distribution ``before`` (node, pi) on the nodes of ``state`` (node), scaled to sum 1; newcomers have
    0. Empty where nothing carries over."""
    rows = state.join(before, "node", "left").withColumn("pi", F.coalesce("pi", F.lit(0.0)))
    total = rows.agg(F.sum("pi").alias("total"))
    return rows.crossJoin(total).where("total > 0").select("node", (F.col("pi") / F.col("total")).alias("pi"))
