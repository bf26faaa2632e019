"""Embedding near-duplicates by NN-descent.

Equal vectors are one node with a weight. Neighbour lists start from several sorted random-projection codes (each vector
against those next to it) and are refined by joining neighbours of neighbours: the members of a list are compared with
one another at their pivot, and every node keeps its best. A list that is saturated - all its entries reach the
threshold - is enlarged, as far as the whole component of threshold links around it: components are scanned in cells of
bounded size, so that every link within them is found and counted, and none is returned as a pair. Lists hold the best
whatever their cosine, and the number of orders grows with the rows, so that two vectors at the threshold with nothing
else near them meet with the chance of the target. The recall of nodes is audited, by size of component and number of
links, on drawn nodes held against all vectors; while it is below the target, another start is made with new projections
and the lists are merged, and the run fails if it stays below.

Defined results: vectors that are null, empty, zero or not finite link with nothing, as do vectors of another length;
repeated rows (or ids) are rows of their own that link with one another; a null id gets a row; extra columns are not
looked at; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import compare, deal, groups
from .common import components, store
from .vectors import cosines, matrix, unit, usable


def orders(n: int, threshold: float, window: int, recall: float) -> int:
    """How many sorted orders bring two vectors at the threshold within ``window`` places with a chance of ``recall``,
    with nothing else near them: a bit is shared with the chance 1 - angle / pi, and log2(n / window) bits are needed."""
    chance = (1 - np.arccos(threshold) / np.pi) ** np.log2(max(n / window, 1))
    return int(np.ceil(np.log(1 / (1 - recall)) / chance))


def kept(cos: np.ndarray, each: int, threshold: float, more: int) -> np.ndarray:
    """The ``each`` best of a row, whatever they are, and the best ``more`` that reach the threshold; -2 is none."""
    there = cos > -2
    if cos.shape[1] <= each:
        return there
    more = min(more, cos.shape[1])
    place = np.partition(cos, (-more, -each), axis=1)
    return there & ((cos >= place[:, -each, None]) | (cos >= np.maximum(place[:, -more], threshold)[:, None]))


def starts(nodes: DataFrame, dims: int, trees: int, window: int, each: int, more: int, threshold: float, seed: int) -> DataFrame:
    """(a, b, cos): each vector's best among the ``window`` on either side in each of ``trees`` sorted orders of sign codes."""

    def codes(batches):
        import pyarrow as pa

        for b in batches:
            x = unit(matrix(b.column("vector")))
            rng = np.random.default_rng(seed)
            for t in range(trees):
                planes = rng.standard_normal((dims, 40))
                bits = (x @ planes > 0) @ (1 << np.arange(40, dtype=np.int64)[::-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(bits), b.column("node"), b.column("vector")], ["tree", "code", "node", "vector"])

    kind = dict(nodes.dtypes)["vector"]
    sorted_ = nodes.select("node", "vector").mapInArrow(codes, f"tree int, code long, node long, vector {kind}")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = sorted_.repartitionByRange(parts, "tree", "code", "node").sortWithinPartitions("tree", "code", "node")

    def sweep(batches):
        import pyarrow as pa

        held = None  # the last rows of the batch before
        for b in batches:
            t, ids, x = b.column("tree").to_numpy(), b.column("node").to_numpy(), unit(matrix(b.column("vector")))
            old = 0
            if held is not None:
                old = len(held[1])
                t, ids, x = np.concatenate([held[0], t]), np.concatenate([held[1], ids]), np.concatenate([held[2], x])
            edges = [0, *range(old or window, len(ids), window), len(ids)]
            blocks = list(zip(edges, edges[1:], strict=False))
            before, found = None, []
            for k, (s, e) in enumerate(blocks):  # a block is held against itself and the one behind
                cols, parts_ = [], []
                if before is not None:
                    cols.append(np.arange(*blocks[k - 1]))
                    parts_.append(before.T)
                if k or not old:
                    own = cosines(x[s:e], x[s:e], threshold)
                    np.fill_diagonal(own, -2.0)
                    cols.append(np.arange(s, e))
                    parts_.append(np.where(t[s:e, None] == t[s:e], own, -2.0))
                if k + 1 < len(blocks):
                    u, v = blocks[k + 1]
                    before = np.where(t[s:e, None] == t[u:v], cosines(x[s:e], x[u:v], threshold), -2.0)
                    cols.append(np.arange(u, v))
                    parts_.append(before)
                if parts_:
                    cos, col = np.concatenate(parts_, axis=1), np.concatenate(cols)
                    r, c = np.nonzero(kept(cos, each, threshold, more))
                    found.append((ids[s + r], ids[col[c]], cos[r, c]))
            held = t[-window:], ids[-window:], x[-window:]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b", "cos"])

    return sorted_.mapInArrow(sweep, "a long, b long, cos double")


def best(pairs: DataFrame, k: int, threshold: float, most: int) -> DataFrame:
    """Lists (a, b, cos, fresh): the ``k`` best of each node, or ``most`` where they all reach the threshold; ``pairs`` may
    hold earlier lists (fresh = 0)."""
    if "fresh" not in pairs.columns:
        pairs = pairs.withColumn("fresh", F.lit(1))
    both = pairs.select("a", "b", "cos", "fresh").union(pairs.select("b", "a", "cos", "fresh")).groupBy("a", "b").agg(F.max("cos").alias("cos"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))
    # the first bound is one of its own, so that a hub's window is cut in every task before it is sorted
    return both.withColumn("place", place).where(F.col("place") <= max(k, most)).where((F.col("place") <= k) | (F.col("cos") >= threshold)).drop("place")


def refine(lists: DataFrame, nodes: DataFrame, each: int, more: int, threshold: float) -> DataFrame:
    """(a, b, cos) between the neighbours of each node."""
    with_vectors = lists.join(nodes.select(F.col("node").alias("b"), "vector"), "b")
    pivots = with_vectors.groupBy("a").agg(F.collect_list(F.struct("b", "vector")).alias("near"))  # a list's length at most
    pivots = pivots.where(F.size("near") > 1).select(F.transform("near", lambda x: x.b).alias("ids"), F.transform("near", lambda x: x.vector).alias("vectors"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            flat = b.column("vectors").flatten()
            x = unit(matrix(flat)) if len(flat) else np.zeros((0, 1))
            ids, at = b.column("ids").flatten().to_numpy(), 0
            out = []
            for n in np.diff(b.column("ids").offsets.to_numpy()).tolist():
                own, y = ids[at : at + n], x[at : at + n]
                at += n
                cos = cosines(y, y, threshold)
                np.fill_diagonal(cos, -2)
                i, j = np.nonzero(kept(cos, each, threshold, more))
                out.append((np.minimum(own[i], own[j]), np.maximum(own[i], own[j]), cos[i, j]))
            if out:
                p, q, cos = (np.concatenate(c) for c in zip(*out, strict=True))
                order = np.lexsort((q, p))
                p, q, cos = p[order], q[order], cos[order]
                new = np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])[: len(p)]
                yield pa.RecordBatch.from_arrays([pa.array(p[new]), pa.array(q[new]), pa.array(cos[new])], ["a", "b", "cos"])

    return pivots.mapInArrow(run, "a long, b long, cos double").where("a <> b")


def crossings(lists: DataFrame, classes: DataFrame, nodes: DataFrame, threshold: float, most: int, block: int) -> DataFrame | None:
    """(a, b): a link between each two chunks of saturated nodes that have one and lie in different components.

    A link is missing from both lists only where both are saturated, so saturated nodes are compared exactly across
    components. Each component's are dealt over chunks; chunks meet where the angle between their centres leaves room
    for a link, by their radii."""
    full = lists.where(F.col("cos") >= threshold).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= most)
    if full.isEmpty():
        return None
    full = full.select("id").join(classes, "id")
    sizes = full.groupBy("component").agg(F.count("*").alias("size"))
    chunk = F.pmod(F.xxhash64("id", F.lit(block)), F.ceil(F.col("size") / F.lit(block)).cast("int")).cast("int")
    members = full.join(sizes, "component").withColumn("k", chunk).join(nodes.select(F.col("node").alias("id"), "vector"), "id")
    members = store(members.select("component", "k", "id", "vector"), "saturated")
    room = float(np.arccos(threshold)) + 1e-6

    def balls(batches):
        import pyarrow as pa

        for (component, k), t in groups(batches, ["component", "k"]):
            x = unit(matrix(t.column("vector")))
            mid = x.sum(0)
            mid = mid / np.linalg.norm(mid) if np.linalg.norm(mid) > 1e-9 else x[0]
            yield pa.RecordBatch.from_pylist([{"component": int(component), "k": int(k), "centre": mid.tolist(), "radius": float(np.arccos(np.clip(x @ mid, -1, 1)).max())}])

    keys = ["component", "k"]
    around = members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(balls, "component long, k long, centre array<double>, radius double")
    around = store(around.withColumn("ball", F.monotonically_increasing_id()), "balls")
    many = around.count()

    def close(batches):
        import pyarrow as pa

        for (i, j), t in groups(batches, ["i", "j"]):
            ids, own, k, r = (t.column(c).to_numpy() for c in ("ball", "component", "k", "radius"))
            left, right, x = np.flatnonzero(k == i), np.flatnonzero(k == j), unit(matrix(t.column("centre")))
            near = np.arccos(np.clip(x[left] @ x[right].T, -1, 1)) <= r[left][:, None] + r[right] + room
            near &= own[left][:, None] != own[right]
            a, b = np.nonzero(near if i != j else np.triu(near, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[left[a]]), pa.array(ids[right[b]])], ["x", "y"])

    cells = deal(around.drop("k").withColumn("size", F.lit(many)), "", "size", "ball", 2048)
    pairs = cells.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(close, "x long, y long")
    pairs = store(pairs.withColumn("pair", F.monotonically_increasing_id()), "meetings")
    sides = pairs.select("pair", F.explode(F.array(F.struct(F.col("x").alias("ball"), F.lit(0).alias("side")), F.struct(F.col("y").alias("ball"), F.lit(1).alias("side")))).alias("s"))
    sides = sides.select("pair", "s.ball", "s.side").join(around.select("ball", "component", "k"), "ball").join(members, ["component", "k"])

    def meet(batches):
        import pyarrow as pa

        for _, t in groups(batches, ["pair"]):
            side, ids, x = t.column("side").to_numpy(), t.column("id").to_numpy(), unit(matrix(t.column("vector")))
            hit = np.argwhere(cosines(x[side == 0], x[side == 1], threshold) >= threshold)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(ids[side == 0][hit[:1, 0]]), pa.array(ids[side == 1][hit[:1, 1]])], ["a", "b"])

    return store(sides.select("pair", "side", "id", "vector").repartition("pair").sortWithinPartitions("pair").mapInArrow(meet, "a long, b long"), "crossings")


#: Probes are drawn by size of component, and recall is told by number of true links: up to each of these, and above.
SIZES = (1, 3, 48)


def audit(nodes: DataFrame, classes: DataFrame, threshold: float, audited: int, seed: int, block: int = 4096) -> tuple[float, DataFrame]:
    """The recall of nodes (a node's share of true links within its component) and links that are missing.

    At least ``audited`` nodes, and the square root of all, are drawn from each range of component sizes and held
    against all vectors. The recall is the least of those over nodes with few, some and many true links, each node
    weighted by what it stands for."""
    sizes = classes.groupBy("component").agg(F.count("*").alias("size"))
    own = nodes.select("node", "vector").join(classes.select(F.col("id").alias("node"), "component"), "node", "left").join(sizes, "component", "left")
    own = own.select("node", "vector", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
    stratum = sum(F.when(F.col("size") > s, 1).otherwise(0) for s in SIZES)
    own = store(own.select("node", "vector", "component", stratum.alias("stratum")), "audited")
    many = {r.stratum: r.n for r in own.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(F.xxhash64("node", F.lit(seed)), "node"))
    drawn = own.withColumn("place", place).where(F.col("place") <= max(audited, int(sum(many.values()) ** 0.5)))
    probe = drawn.select("node", "vector", "component", "stratum").collect()  # bounded: four strata
    per = {s: sum(r.stratum == s for r in probe) for s in many}
    weight = [many[r.stratum] / per[r.stratum] for r in probe]
    if not probe:
        return 1.0, nodes.sparkSession.createDataFrame([], "a long, b long")
    ids, x, home = np.array([r.node for r in probe]), unit(np.array([r.vector for r in probe], float)), np.array([r.component for r in probe])

    def run(batches):
        import pyarrow as pa

        n, hit = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        lost: set[tuple[int, int]] = set()  # one link for a probe and a component
        for b in batches:
            node, at, y = b.column("node").to_numpy(), b.column("component").to_numpy(), unit(matrix(b.column("vector")))
            out = []
            for s in range(0, len(node), block):
                r, c = np.nonzero(cosines(x, y[s : s + block], threshold) >= threshold)
                c += s
                r, c = r[ids[r] != node[c]], c[ids[r] != node[c]]
                same = home[r] == at[c]
                n += np.bincount(r, minlength=len(ids))
                hit += np.bincount(r[same], minlength=len(ids))
                for p, q in zip(r[~same].tolist(), c[~same].tolist(), strict=True):
                    if (p, int(at[q])) not in lost:
                        lost.add((p, int(at[q])))
                        out.append((p, int(node[q])))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64())], ["p", "b", "n", "hit"])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.nulls(len(some), pa.int64()), pa.array(n[some]), pa.array(hit[some])], ["p", "b", "n", "hit"])

    told = store(own.select("node", "component", "vector").mapInArrow(run, "p long, b long, n long, hit long"), "audit")
    counts = told.where("b is null").groupBy("p").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).collect()  # one row for a probe
    least = 1.0
    for lo, hi in zip((0, *SIZES[1:]), (*SIZES[1:], float("inf")), strict=True):
        rows = [(weight[r.p], r.hit / r.n) for r in counts if lo < r.n <= hi]
        if rows:
            least = min(least, sum(w * h for w, h in rows) / sum(w for w, _ in rows))
    names = nodes.sparkSession.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], "p long, a long")
    return least, store(told.where("b is not null").join(F.broadcast(names), "p").select("a", "b").distinct(), "lost")


def near_duplicates(table: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", k: int = 12, most: int = 48, trees: int = 12, window: int = 64, each: int = 4, more: int = 12, rounds: int = 4, settled: float = 0.005, recall: float = 0.995, audited: int = 256, attempts: int = 8, block: int = 512) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of ``table``. Raises if the audited recall stays below ``recall``."""
    rows = store(table.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    fine = usable(rows, "vector")
    same = fine.groupBy("vector").agg(F.min("row").alias("node"), F.count("*").alias("weight"), F.min("key").alias("least"))
    all_nodes = store(same, "nodes")
    out = None
    for dims, many in sorted(all_nodes.groupBy(F.size("vector")).count().collect()):  # one, unless lengths differ
        nodes = all_nodes.where(F.size("vector") == dims)
        lists, seed, missing = None, 100, None
        wanted = orders(many, threshold, window, recall)
        for attempt in range(attempts):
            left = wanted
            while left > 0:  # an attempt's orders, so many at a time
                found = starts(nodes, dims, -(-wanted // -(-wanted // trees)), window, each, more, threshold, seed).withColumn("fresh", F.lit(1))
                lists = store(best(found if lists is None else found.unionByName(lists.withColumn("fresh", F.lit(0))), k, threshold, most), "lists")
                seed, left = seed + 1, left - trees
            for _ in range(rounds):
                found = refine(lists, nodes, each, more, threshold).withColumn("fresh", F.lit(1))
                lists = store(best(found.unionByName(lists.withColumn("fresh", F.lit(0))), k, threshold, most), "lists")
                size, fresh = lists.agg(F.count("*"), F.coalesce(F.sum("fresh"), F.lit(0))).first()
                if fresh <= settled * max(size, 1):
                    break
            # a list that is cut may have lost a link that the other node's list still has
            links = lists.where(F.col("cos") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            classes = store(components(links, "linked"), "classes")
            across = crossings(lists, classes, nodes, threshold, most, block)
            if across is not None and not across.isEmpty():
                links = links.unionByName(across)
                classes = store(components(links, "linked"), "classes")
            share, lost = audit(nodes, classes, threshold, audited, attempt)
            if not lost.isEmpty():  # what the audits found is kept
                missing = lost if missing is None else missing.unionByName(lost)
            if share >= recall:
                break
        else:
            raise RuntimeError(f"op1: recall of nodes is {share:.4f} after {attempts} attempts, below {recall}")
        if missing is not None:
            classes = store(components(links.unionByName(missing), "linked"), "classes")
        sizes = classes.groupBy("component").agg(F.count("*").alias("size"))
        members = classes.join(sizes, "component").join(nodes.select(F.col("node").alias("id"), "weight", "vector"), "id")

        def similar(t, left, right):
            x = unit(matrix(t.column("vector")))
            return cosines(x[left], x[right], threshold) >= threshold

        links = compare(deal(members, "component", "size", "id", block), "component", "id", "weight", similar)
        counts = links.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        own = nodes.join(classes.withColumnRenamed("id", "node"), "node", "left").join(counts, "node", "left")
        own = own.select("vector", "weight", "least", F.coalesce("component", "node").alias("component"), F.coalesce("n", F.lit(0)).alias("n"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = all_nodes.select("vector", "weight", "least", F.col("node").alias("component"), F.lit(0).cast("long").alias("n"))
    least = out.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = out.join(least, "component").select("vector", "component_id", (F.col("n") + F.col("weight") - 1).alias("n_links"))
    joined = rows.select("key", "vector").join(labels, "vector", "left").select("key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "key").alias("component_id"))
    return joined.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def oracle(threshold: float = 0.9, table: str = "embeddings") -> str:
    """All pairs as SQL, for vectors that all have a direction and ids that are unique."""
    return f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM {table}),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
r(id, root) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.id, l.b FROM r JOIN l ON r.root = l.a),
c AS (SELECT id AS vec_id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
