"""Slices, neighbourhoods and communities of the flow graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .flux import union_top
from .stats import global_place


def top_arcs(edges: DataFrame, n: int) -> DataFrame:
    return edges.where("src <> dst").orderBy(F.desc("w"), "src", "dst").limit(n)


def neighbours(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, w): each node's ``k`` heaviest edges out and in, each edge once."""
    return union_top(edges.where("src <> dst and w > 0").select("src", "dst", "w"), k, k)


def subgraph(edges: DataFrame, focus: DataFrame, k: int) -> DataFrame:
    """The nodes of ``focus`` (node) with each one's ``k`` strongest neighbours (by the heavier of the two directions, ties
    to the lower index), and all of ``edges`` among them."""
    f = F.broadcast(focus.select("node").distinct())  # a few nodes asked for
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "w").union(edges.select("dst", "src", "w"))
    near = both.join(f, "node", "left_semi").where("node <> other").groupBy("node", "other").agg(F.max("w").alias("w"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "other"))
    chosen = near.withColumn("place", place).where(F.col("place") <= k).select(F.col("other").alias("node"))
    return induced(edges, focus.select("node").union(chosen).distinct())


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (node)."""
    return edges.join(nodes, edges.src == nodes.node, "left_semi").join(nodes, edges.dst == nodes.node, "left_semi")


def slice_nodes(pi: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(node): the node with the largest pi and its n - 1 strongest two-way partners."""
    hub = pi.orderBy(F.desc("pi"), "node").limit(1).select(F.col("node").alias("hub"))
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("y"), "w").union(edges.select("dst", "src", "w"))
    partners = both.join(hub, both.x == hub.hub).where("y <> hub").groupBy(F.col("y").alias("node")).agg(F.sum("w").alias("w"))
    return hub.select(F.col("hub").alias("node")).union(partners.orderBy(F.desc("w"), "node").limit(n - 1).select("node"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, w) with w(a, b) = w(b, a) = flow either way, off the diagonal."""
    e = edges.where("src <> dst and w > 0").select("src", "dst", "w")
    return e.union(e.select(F.col("dst"), F.col("src"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def community_graph(sym: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, w): weight between communities of ``labels`` (node, community)."""
    a, b = labels.select(F.col("node").alias("src"), F.col("community").alias("a")), labels.select(F.col("node").alias("dst"), F.col("community").alias("b"))
    return sym.join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.sum("w").alias("w"))


def modularity(sym: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: sum over communities of inner / total - (degree / total)^2."""
    cg = community_graph(sym, labels)
    rows = cg.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("own"), F.sum("w").alias("deg"))
    total = cg.agg(F.sum("w").alias("total"))
    return rows.crossJoin(total).agg(F.sum(F.col("own") / F.col("total") - F.pow(F.col("deg") / F.col("total"), F.lit(2.0))).alias("modularity"))  # one row


LOOSE = -2


def louvain(sym: DataFrame, resolution: float = 1.0, smallest: int = 8, most: int = 256, passes: int = 50, local_edges: int = 3_000_000) -> DataFrame:
    """(node, community): two-phase modularity ascent in node order, gains above 1e-12, ties to the lowest label, at most
    ``passes`` rounds a level. Then the smallest group joins its strongest neighbour while it is under ``smallest`` or there
    are more than ``most``; one without a neighbour is loose (-2). A community is named after its smallest node.

    Sequential by definition, so one task on a pruned graph; raises for one of more than ``local_edges`` edges."""
    sym = sym.persist()  # counted, then read
    if sym.count() > local_edges:
        raise ValueError(f"louvain takes at most {local_edges} edges in one task; prune the graph first")

    def run(pdf):
        import pandas as pd

        graph: dict[int, dict[int, float]] = {}
        for s, d, w in zip(pdf["src"], pdf["dst"], pdf["w"], strict=True):
            graph.setdefault(int(s), {})[int(d)] = float(w)
        member = {v: v for v in graph}
        level, loops = {v: dict(n) for v, n in graph.items()}, dict.fromkeys(graph, 0.0)
        while True:
            degree = {v: sum(n.values()) + loops[v] for v, n in level.items()}
            m2 = sum(degree.values()) or 1.0
            label, weight, moved_any, moved = {v: v for v in level}, dict(degree), False, True
            rounds = 0
            while moved and rounds < passes:
                moved, rounds = False, rounds + 1
                for v in sorted(level):
                    links: dict[int, float] = {}
                    for u, w in level[v].items():
                        links[label[u]] = links.get(label[u], 0.0) + w
                    own = label[v]
                    weight[own] -= degree[v]
                    stay = links.get(own, 0.0) - resolution * degree[v] * weight[own] / m2
                    best, gain = own, stay
                    for c in sorted(links):
                        g = links[c] - resolution * degree[v] * weight[c] / m2
                        if g > gain + 1e-12:
                            best, gain = c, g
                    weight[best] += degree[v]
                    if best != own:
                        label[v], moved, moved_any = best, True, True
            member = {v: label[c] for v, c in member.items()}
            if not moved_any:
                break
            merged: dict[int, dict[int, float]] = {c: {} for c in set(label.values())}
            new_loops = dict.fromkeys(merged, 0.0)
            for v, n in level.items():
                new_loops[label[v]] += loops[v]
                for u, w in n.items():
                    if label[u] == label[v]:
                        new_loops[label[v]] += w
                    else:
                        merged[label[v]][label[u]] = merged[label[v]].get(label[u], 0.0) + w
            level, loops = merged, new_loops
        groups: dict[int, list[int]] = {}
        for v, c in member.items():
            groups.setdefault(c, []).append(v)
        groups = {min(own): own for own in groups.values()}
        home = {v: c for c, own in groups.items() for v in own}
        pull: dict[int, dict[int, float]] = {c: {} for c in groups}
        for v, near in graph.items():
            for u, w in near.items():
                if home[u] != home[v]:
                    pull[home[v]][home[u]] = pull[home[v]].get(home[u], 0.0) + w
        loose: list[int] = []
        while groups:
            c = min(groups, key=lambda k: (len(groups[k]), k))
            if len(groups[c]) >= smallest and len(groups) <= most:
                break
            near, own = pull.pop(c), groups.pop(c)
            if not near:
                loose += own
                continue
            to = min(near, key=lambda k: (-near[k], k))
            groups[to] += own
            for k, w in near.items():
                pull[k].pop(c)
                if k != to:
                    pull[k][to] = pull[k].get(to, 0.0) + w
                    pull[to][k] = pull[to].get(k, 0.0) + w
        named = [(v, min(own)) for own in groups.values() for v in own] + [(v, LOOSE) for v in loose]
        return pd.DataFrame(named, columns=["node", "community"])

    return sym.groupBy(F.lit(0).alias("all")).applyInPandas(run, "node long, community long")


def gravity(margin: DataFrame, support: DataFrame | None = None, cells: int = 25_000_000) -> DataFrame:
    """(src, dst, w): out in / total for all ordered pairs, or on the edges of ``support`` with rows scaled to outflow.

    All pairs are the result without a support: the margins are found once, and each task forms the rows of its sources,
    about ``cells`` pairs, from the sinks that every task has. No pair is shuffled."""
    margin = margin.persist()  # a row for each node, read for the sources, the sinks and the total
    total = margin.agg(F.sum("outflow").alias("total"))
    a = margin.where("outflow > 0").select(F.col("node").alias("src"), "outflow")
    b = margin.where("inflow > 0").select(F.col("node").alias("dst"), "inflow")
    if support is None:  # use a support on large graphs
        n = margin.count()
        a = a.crossJoin(total).repartition(max(1, -(-n * n // cells)), "src").sortWithinPartitions("src")  # one row
        rows = a.join(F.broadcast(b), F.col("src") != F.col("dst"))
        return rows.select("src", "dst", (F.col("outflow") * F.col("inflow") / F.col("total")).alias("w"))
    rows = support.select("src", "dst").where("src <> dst").join(a, "src").join(b, "dst")
    return rows.select("src", "dst", (F.col("outflow") * F.col("inflow") / F.sum("inflow").over(Window.partitionBy("src"))).alias("w"))


def row_cosine(x: DataFrame, y: DataFrame) -> DataFrame:
    """(src, cosine) of the rows of two edge lists."""
    both = x.select("src", "dst", F.col("w").alias("x")).join(y.select("src", "dst", F.col("w").alias("y")), ["src", "dst"], "full")
    a, b = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    return both.groupBy("src").agg(F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"))


def top_overlap(x: DataFrame, y: DataFrame, k: int) -> DataFrame:
    """One row: shared edges of the two top-k lists over min(k, size of either)."""
    tx, ty = (e.orderBy(F.desc("w"), "src", "dst").limit(k).select("src", "dst") for e in (x, y))
    n = tx.agg(F.count("*").alias("nx")).crossJoin(ty.agg(F.count("*").alias("ny"))).crossJoin(tx.intersect(ty).agg(F.count("*").alias("s")))
    return n.select(F.try_divide(F.col("s"), F.least(F.lit(k), "nx", "ny")).alias("overlap"))


def largest_remainder(nodes: DataFrame, share: str, cells: int) -> DataFrame:
    """(node, cells): integer cells in proportion to ``share``: floors, then one more to the largest remainders."""
    total = nodes.agg(F.sum(share).alias("total"))
    rows = nodes.crossJoin(total).withColumn("exact", F.col(share) * cells / F.col("total"))
    rows = rows.withColumn("low", F.floor("exact").cast("long"))
    left = rows.agg((F.lit(cells) - F.sum("low")).alias("left"))
    rows = global_place(rows.withColumn("over", F.round(F.col("exact") - F.col("low"), 9)), "over", ["node"], descending=True)
    return rows.crossJoin(left).select("node", (F.col("low") + (F.col("place") <= F.col("left")).cast("long")).alias("cells"))


def transpose(edges: DataFrame, weight: str = "p") -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), weight)


def multiply(x: DataFrame, p: DataFrame) -> DataFrame:
    """(node, y) = x P for a row vector x (node, x) and edges (src, dst, p); nodes that nothing reaches are left out."""
    return x.join(p, x["node"] == p["src"]).groupBy("dst").agg(F.sum(F.col("x") * F.col("p")).alias("y")).withColumnRenamed("dst", "node")


def size(edges: DataFrame) -> DataFrame:
    """One row (total, edge_count)."""
    return edges.agg(F.sum("w").alias("total"), F.count("*").alias("edge_count"))


def margins(edges: DataFrame) -> DataFrame:
    """(node, inflow, outflow) of an edge list off the diagonal."""
    both = edges.where("src <> dst and w > 0").select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0.0).alias("i"), F.col("w").alias("o")), F.struct(F.col("dst").alias("node"), F.col("w").alias("i"), F.lit(0.0).alias("o")))).alias("x"))
    return both.groupBy("x.node").agg(F.sum("x.i").alias("inflow"), F.sum("x.o").alias("outflow"))


def top_nodes(values: DataFrame, value: str, k: int) -> DataFrame:
    """(node): the ``k`` largest, ties to the lower index."""
    return values.orderBy(F.desc(value), "node").limit(k).select("node")


def prior_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, logp, z, g, same, ratio) of edges (src, dst, p, raw): the logarithm of the row's renormalised share, its
    z-score over all edges, the normal rank of the raw flow within the row, whether ``nodes`` (node, sector, size) gives
    both the same sector, and the logarithm of their size ratio, clipped to 3."""
    from .stats import rank_gauss

    share = F.col("p") / F.sum("p").over(Window.partitionBy("src"))
    rows = edges.where("p > 0").withColumn("logp", F.ln(share))
    level = rows.agg(F.avg("logp").alias("m"), F.stddev_pop("logp").alias("s"))
    rows = rank_gauss(rows, "raw", ["src"]).crossJoin(level)  # one row
    a, b = (nodes.select(F.col("node").alias(end), F.col("sector").alias(f"sector_{end}"), F.col("size").alias(f"size_{end}")) for end in ("src", "dst"))
    rows = rows.join(a, "src").join(b, "dst")
    ratio = F.ln(F.col("size_dst") / F.col("size_src"))
    return rows.select("src", "dst", "logp", F.coalesce(F.try_divide(F.col("logp") - F.col("m"), F.col("s")), F.lit(0.0)).alias("z"), "g", (F.col("sector_src") == F.col("sector_dst")).cast("double").alias("same"), F.greatest(F.lit(-3.0), F.least(F.lit(3.0), ratio)).alias("ratio"))


def message(x: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, y): each node's mean of its sources' values, weighted by the edges: one step over a fixed graph."""
    rows = edges.join(x.select(F.col("node").alias("src"), "x"), "src").where("x is not null")
    return rows.groupBy("dst").agg((F.sum(F.col("p") * F.col("x")) / F.sum("p")).alias("y")).withColumnRenamed("dst", "node")
