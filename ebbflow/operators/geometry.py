"""Lattices, territories and rasters: where a landscape puts its nodes and how it is drawn.

Layouts follow an order over all nodes of one frame, so they run in one task over one row for each node; rasters are joins
of pixels with their neighbourhood.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lattice_size(n: int) -> tuple[int, int]:
    """(columns, rows) of the near-square lattice for ``n`` cells."""
    cols = math.ceil(math.sqrt(n))
    return (cols, -(-n // cols)) if n else (0, 0)


def curve(cols: int, rows: int) -> np.ndarray:
    """All cells of a lattice in the order of the generalised Hilbert curve: each next to the one before (or, for odd
    sides, at its corner). A rectangle is its corner and two edge vectors; a stack of them is cut until they are lines."""
    out = []
    if cols and rows:
        a, b = ((cols, 0), (0, rows)) if cols >= rows else ((0, rows), (cols, 0))
        todo = [((0, 0), a, b)]
        while todo:
            p, a, b = (np.array(v) for v in todo.pop())
            w, h = abs(a.sum()), abs(b.sum())
            da, db = np.sign(a), np.sign(b)
            if h == 1 or w == 1:
                step, n = (da, w) if h == 1 else (db, h)
                out += [tuple(p + i * step) for i in range(n)]
                continue
            half_a, half_b = a // 2, b // 2
            if 2 * w > 3 * h:  # a long one: two along it
                if abs(half_a.sum()) % 2 and w > 2:
                    half_a = half_a + da
                parts = [(p, half_a, b), (p + half_a, a - half_a, b)]
            else:  # up, across and down again
                if abs(half_b.sum()) % 2 and h > 2:
                    half_b = half_b + db
                parts = [(p, half_b, half_a), (p + half_b, a, b - half_b), (p + a - da + half_b - db, -half_b, half_a - a)]
            todo += parts[::-1]
    return np.array([y * cols + x for x, y in out], np.int64)


def shares_of(counts: list[int], cells: int) -> list[int]:
    """Cells for each group: its own number, and a part of the spare ones by largest remainder, ties to the earlier."""
    total = sum(counts)
    spare = cells - total
    whole = [c * spare // total for c in counts]
    order = sorted(range(len(counts)), key=lambda k: (-(counts[k] * spare % total), k))
    for k in order[: spare - sum(whole)]:
        whole[k] += 1
    return [c + w for c, w in zip(counts, whole, strict=True)]


def spiral(cells: np.ndarray, cols: int) -> np.ndarray:
    """A territory's cells from its centre outward: by ring, then angle, then cell."""
    x, y = cells % cols + 0.5, cells // cols + 0.5
    dx, dy = x - x.mean(), y - y.mean()
    angle = np.arctan2(dy, dx)
    angle[angle == np.pi] = -np.pi
    return cells[np.lexsort((cells, angle, np.floor(np.sqrt(dx * dx + dy * dy))))]


def place(ideal: int, before: dict[int, int], cells: np.ndarray, order: np.ndarray, tolerance: float) -> np.ndarray:
    """The slot of each node of ``order``: its cell of before if that is near its place in the order, else its own place
    if free, else the nearest free one, ties to the lower."""
    slots = {int(c): k for k, c in enumerate(cells)}
    near, slot, free = max(2.0, tolerance * len(cells)), np.full(len(order), -1), np.ones(len(cells), bool)
    for k, node in enumerate(order.tolist()):
        at = slots.get(before.get(node, -1), -1)
        if at >= 0 and free[at] and abs(at - k) <= near:
            slot[k], free[at] = at, False
    for k in range(len(order)):
        if slot[k] < 0 and free[k]:
            slot[k], free[k] = k, False
    for k in np.flatnonzero(slot < 0):
        open_ = np.flatnonzero(free)
        slot[k] = open_[np.lexsort((open_, np.abs(open_ - k)))[0]]
        free[slot[k]] = False
    return slot


def territory_layout(nodes: DataFrame, cols: int, rows: int, before: DataFrame | None = None, tolerance: float = 0.05) -> DataFrame:
    """(frame, node, cell, territory, mountain) of nodes (frame, node, community, value): communities take stretches of the
    curve, in the order of their number and by their size; within one, nodes go from the centre outward, the highest first
    on a mountain (whose median value is that of all or more), the lowest first in a basin. ``before`` (frame, node, cell)
    is the layout to stay near. A group is one frame."""
    order = curve(cols, rows)

    def run(pdf):
        import pandas as pd

        if len(pdf) > cols * rows:
            raise ValueError("the lattice is smaller than the number of nodes")
        pdf = pdf.sort_values(["community", "node"]).fillna({"value": 0.0})
        mid, at, out = pdf["value"].median(), 0, []
        groups = [g for _, g in pdf.groupby("community", sort=True)]
        for t, (g, n) in enumerate(zip(groups, shares_of([len(g) for g in groups], cols * rows), strict=True)):
            cells = spiral(order[at : at + n], cols)
            at += n
            mountain = bool(g["value"].median() >= mid)
            g = g.sort_values(["value", "node"], ascending=[not mountain, True], kind="stable")
            held = {int(k): int(c) for k, c in zip(g["node"], g["cell"], strict=True) if c >= 0} if "cell" in g else {}
            slot = place(0, held, cells, g["node"].to_numpy(), tolerance) if held else np.arange(len(g))
            out.append(pd.DataFrame({"frame": g["frame"], "node": g["node"], "cell": cells[slot], "territory": t, "mountain": mountain}))
        return pd.concat(out)

    if before is not None:
        nodes = nodes.join(before.select("frame", "node", "cell"), ["frame", "node"], "left").fillna(-1, ["cell"])
    return nodes.groupBy("frame").applyInPandas(run, "frame long, node long, cell long, territory long, mountain boolean")


def pixels(spark, cols: int, rows: int, subdivision: int) -> DataFrame:
    """(px, py, u, v): all pixels and their centres, in cells."""
    s = max(1, subdivision)
    grid = spark.range(cols * s * rows * s).select((F.col("id") % (cols * s)).alias("px"), F.floor(F.col("id") / (cols * s)).alias("py"))
    return grid.select("px", "py", ((F.col("px") + 0.5) / s).alias("u"), ((F.col("py") + 0.5) / s).alias("v"))


def idw(values: DataFrame, cols: int, rows: int, subdivision: int = 1, radius: int = 3, power: float = 2.0) -> DataFrame:
    """(px, py, z) of values (cell, value): exact at a cell's centre, else inverse-distance weights over the cells within
    ``radius`` of the pixel's own, else the value of the nearest cell that has one (by steps over the lattice, ties to the
    lower cell)."""
    spark = values.sparkSession
    own = values.where("value is not null").select((F.col("cell") % cols).alias("cc"), F.floor(F.col("cell") / cols).alias("cr"), "cell", "value")
    grid = pixels(spark, cols, rows, subdivision).withColumns({"c0": F.floor("u"), "r0": F.floor("v")})
    around = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    near = own.withColumn("dx", around).withColumn("dy", around).select((F.col("cc") + F.col("dx")).alias("c0"), (F.col("cr") + F.col("dy")).alias("r0"), "cc", "cr", "value")
    d = F.hypot(F.col("u") - (F.col("cc") + 0.5), F.col("v") - (F.col("cr") + 0.5))
    w = F.when(F.col("d") >= 1e-9, 1 / F.pow("d", F.lit(power)))
    met = grid.join(near, ["c0", "r0"]).withColumn("d", d).groupBy("px", "py").agg(F.max(F.when(F.col("d") < 1e-9, F.col("value"))).alias("exact"), (F.sum(w * F.col("value")) / F.sum(w)).alias("mean"))
    rows_ = grid.join(met, ["px", "py"], "left")
    # pixels with nothing around: cells are held against them by lattice distance
    empty = rows_.where("exact is null and mean is null").select("px", "py", "c0", "r0")
    steps = F.greatest(F.abs(F.col("cc") - F.col("c0")), F.abs(F.col("cr") - F.col("r0")))
    far = empty.crossJoin(F.broadcast(own)).groupBy("px", "py").agg(F.min_by("value", F.struct(steps, F.col("cell"))).alias("far"))  # the lattice's cells
    return rows_.join(far, ["px", "py"], "left").select("px", "py", F.coalesce("exact", "mean", "far").alias("z"))


def smooth(raster: DataFrame, sigma: float) -> DataFrame:
    """(px, py, z): Gaussian weights along rows, then along columns, over three deviations, scaled at the borders."""
    if sigma == 0:
        return raster
    if not sigma > 0:
        raise ValueError("sigma must be finite and 0 or more")
    reach = math.ceil(3 * sigma)
    out = raster
    for axis, other in (("px", "py"), ("py", "px")):
        shifted = out.withColumn("k", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).select((F.col(axis) + F.col("k")).alias(axis), other, "k", "z")
        w = F.exp(-0.5 * F.col("k") * F.col("k") / (sigma * sigma))
        out = shifted.join(out.select("px", "py"), ["px", "py"]).groupBy("px", "py").agg((F.sum(w * F.col("z")) / F.sum(w)).alias("z"))
    return out


def cvt_step(raster: DataFrame, eps: float, weight: float, pins: DataFrame | None = None) -> DataFrame:
    """(px, py, z): each pixel moves by ``weight`` to the mean of its 3 x 3 neighbourhood, corners counting half, each
    weighted by eps + |z|; pinned pixels (px, py, z) keep their value."""
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    near = raster.withColumn("dx", around).withColumn("dy", around).select((F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py"), (F.when((F.col("dx") != 0) & (F.col("dy") != 0), 0.5).otherwise(1.0) * (F.lit(eps) + F.abs("z"))).alias("w"), F.col("z").alias("x"))
    mean = near.groupBy("px", "py").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))
    out = raster.join(mean, ["px", "py"]).select("px", "py", ((1 - weight) * F.col("z") + weight * F.col("mean")).alias("z"))
    return out if pins is None else pinned(out, pins)


def pinned(raster: DataFrame, pins: DataFrame) -> DataFrame:
    return raster.join(F.broadcast(pins.select("px", "py", F.col("z").alias("pin"))), ["px", "py"], "left").select("px", "py", F.coalesce("pin", "z").alias("z"))  # a portfolio's pins


def cvt_smooth(raster: DataFrame, steps: int = 12, weight: float = 0.5, eps_share: float = 0.1, pins: DataFrame | None = None) -> DataFrame:
    """``steps`` steps of ``cvt_step``; eps is ``eps_share`` of the 90 % quantile of |z| (the value at that place)."""
    if steps < 0 or not 0 < weight <= 1 or not 0 < eps_share <= 10:
        raise ValueError("steps >= 0, 0 < weight <= 1 and 0 < eps_share <= 10")
    out = raster if pins is None else pinned(raster, pins)
    if not steps:
        return out
    v = out.agg(F.expr("percentile_disc(0.9) within group (order by abs(z))")).first()[0] or 0.0
    for _ in range(steps):
        out = cvt_step(out, eps_share * v if v > 0 else 1.0, weight, pins)
    return out


def delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(px, py, z): the second raster less the first."""
    return a.join(b.withColumnRenamed("z", "z2"), ["px", "py"]).select("px", "py", (F.col("z2") - F.col("z")).alias("z"))


def spectral_order(weights: np.ndarray, counts: list[int], loose: int = -1) -> list[int]:
    """Communities in a line, the loose one last: parts of a graph that hang together are halved by the second eigenvector
    of their normalised weights where the sizes balance best, and each half is turned towards the other."""
    both = weights + weights.T
    np.fill_diagonal(both, 0.0)

    def parts(own: list[int]) -> list[list[int]]:
        left, out = set(own), []
        while left:
            seed = min(left)
            group, todo = {seed}, [seed]
            while todo:
                new = [c for c in left if both[todo[-1], c] > 0 and c not in group]
                todo.pop()
                group |= set(new)
                todo += new
            left -= group
            out.append(sorted(group))
        return sorted(out, key=lambda g: (-sum(counts[c] for c in g), g[0]))

    def line(own: list[int]) -> list[int]:
        if len(own) == 1:
            return own
        pieces = parts(own)
        if len(pieces) > 1:
            return [c for p in pieces for c in line(p)]
        w = both[np.ix_(own, own)]
        degree = w.sum(1)
        values, vectors = np.linalg.eigh(w / np.sqrt(np.outer(degree, degree)))
        x = vectors[:, -2]
        x = x * np.sign(x[np.abs(x).argmax()])
        order = sorted(range(len(own)), key=lambda k: (round(float(x[k]), 12), own[k]))
        upto = np.cumsum([counts[own[k]] for k in order])[:-1]
        cut = int(np.abs(upto - sum(counts[c] for c in own) / 2).argmin()) + 1
        low, high = (sorted(own[k] for k in s) for s in (order[:cut], order[cut:]))
        a, b = line(low), line(high)
        if both[a[0], high].sum() > both[a[-1], high].sum():
            a = a[::-1]
        if both[b[-1], low].sum() > both[b[0], low].sum():
            b = b[::-1]
        return a + b

    own = [c for c in range(len(counts)) if c != loose]
    return (line(own) if own else []) + ([loose] if loose >= 0 else [])


def overlaps(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new, old, shared, jaccard, contained) of two labellings (node, community): how far each pair of communities shares
    its nodes."""
    both = new.select("node", F.col("community").alias("new")).join(old.select("node", F.col("community").alias("old")), "node").groupBy("new", "old").agg(F.count("*").alias("shared"))
    a, b = new.groupBy(F.col("community").alias("new")).agg(F.count("*").alias("a")), old.groupBy(F.col("community").alias("old")).agg(F.count("*").alias("b"))
    rows = both.join(a, "new").join(b, "old")
    return rows.select("new", "old", "shared", (F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.col("a")).alias("contained"))


def match_labels(new: DataFrame, old: DataFrame, jaccard: float = 0.3, contained: float = 0.6) -> DataFrame:
    """(community, label): each new community takes the label of an old one, by the largest overlap first, each label once,
    if they share enough; the others are numbered on after the old ones. One row for each pair of communities."""
    rows = overlaps(new, old).where((F.col("jaccard") >= jaccard) | (F.col("contained") >= contained))
    every = new.select(F.col("community").alias("new")).distinct()
    top = old.agg((F.coalesce(F.max("community"), F.lit(-1)) + 1).alias("next"))
    rows = every.join(rows, "new", "left").crossJoin(top)  # one row

    def run(pdf):
        import pandas as pd

        label, used = {}, set()
        for r in pdf.dropna(subset=["old"]).sort_values(["shared", "new", "old"], ascending=[False, True, True]).itertuples():
            if r.new not in label and r.old not in used:
                label[r.new] = int(r.old)
                used.add(r.old)
        fresh = int(pdf["next"].iloc[0])
        for c in sorted(pdf["new"].unique()):
            if c not in label:
                label[c], fresh = fresh, fresh + 1
        return pd.DataFrame({"community": list(label), "label": list(label.values())})

    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, "community long, label long")  # communities, not nodes


def newcomers(labels: DataFrame, sym: DataFrame, active: DataFrame) -> DataFrame:
    """(node, community) of all active nodes between two clusterings: their label, or for a newcomer that of the community
    it is linked with most (ties to the lower), or -2."""
    fresh = active.select("node").join(labels, "node", "left_anti")
    pull = sym.join(fresh.select(F.col("node").alias("src")), "src").join(labels.where("community >= 0").select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("w").alias("w"))
    best = pull.groupBy(F.col("src").alias("node")).agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("community"))
    return labels.join(active.select("node"), "node", "left_semi").unionByName(fresh.join(best, "node", "left").select("node", F.coalesce("community", F.lit(-2)).alias("community")))


def persistence(labels: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """(frame, lag, n, same_pairs) of labellings (frame, node, community): how many pairs of nodes that share a community
    share one ``lag`` frames later, of those that are in both; by contingency counts, without the pairs."""
    out = None
    for lag in lags:
        later = labels.select((F.col("frame") - lag).alias("frame"), "node", F.col("community").alias("then"))
        both = labels.join(later, ["frame", "node"])
        cells = both.groupBy("frame", "community", "then").agg(F.count("*").alias("n"))
        w = Window.partitionBy("frame", "community")
        rows = cells.withColumn("own", F.sum("n").over(w)).groupBy("frame").agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * (F.col("n") - 1)), F.sum(F.col("n") * (F.col("own") - 1))).alias("same_pairs"))
        rows = rows.withColumn("lag", F.lit(lag))
        out = rows if out is None else out.unionByName(rows)
    return out.select("frame", "lag", "n", "same_pairs")


def arrange_order(spectral: list[int], labels: dict[int, int], before: list[int]) -> list[int]:
    """Labels in the spectral order of their communities, but those that were there before in their old order among
    themselves."""
    own = [labels[c] for c in spectral if c in labels]
    place = {label: k for k, label in enumerate(before)}
    kept = iter(sorted((x for x in own if x in place), key=place.get))
    return [next(kept) if x in place else x for x in own]


def landscape(nodes: DataFrame, cols: int, rows: int, subdivision: int = 2, radius: int = 3, sigma: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The layout (frame, node, cell, territory, mountain) and the smoothed surface (px, py, z) of one frame's nodes (frame,
    node, community, value)."""
    placed = territory_layout(nodes, cols, rows)
    values = placed.join(nodes.select("node", "value"), "node").select("cell", "value")
    return placed, smooth(idw(values, cols, rows, subdivision, radius), sigma * subdivision)
