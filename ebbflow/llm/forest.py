"""Approximate nearest neighbours with a forest of hash prefixes.

Rows are dealt over shards of bounded size. In each shard every tree keeps its rows as a sorted array of long hash
strings: the signs of random projections. A query descends in each tree to its longest matching prefix, of whatever
length that is there, and then all trees ascend together, a bit at a time, taking in the rows that share the shorter
prefix, until enough distinct rows of the shard are found. Those are ranked by the exact cosine, and the best of all
shards are merged. Queries travel to the shards in blocks of bounded size.

Defined results: vectors that are null, empty, zero, not finite or have no id take no part, neither as queries nor as candidates; a
query meets vectors of its own length only; repeated ids are candidates of their own, but never of a query with that id;
ties go to the smaller id; extra columns are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import groups
from .vectors import matrix, unit, usable


class Forest:
    """Sorted arrays of one shard's hash strings: ``trees`` orders of its rows by ``bits`` signs each."""

    def __init__(self, x: np.ndarray, trees: int, bits: int, seed: int = 5):
        self.bits, self.n = bits, len(x)
        rng = np.random.default_rng(seed)
        self.planes, self.order, self.sorted = [], [], []
        for _ in range(trees):
            p = rng.standard_normal((x.shape[1], bits))
            #: within a tree the projections are orthogonal as far as they can be, which evens the angles out
            self.planes.append(np.linalg.qr(p)[0] if bits <= x.shape[1] else p)
            codes = self.codes(x, self.planes[-1])
            order = np.argsort(codes, kind="stable").astype(np.int32)
            self.order.append(order)
            self.sorted.append(codes[order])

    def codes(self, x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        """The hash string of each row, most significant sign first; at most 52 signs, which a double holds too."""
        return (x @ planes > 0) @ (1 << np.arange(self.bits, dtype=np.int64)[::-1])

    def candidates(self, q: np.ndarray, wanted: int, step: int = 512):
        """(query, rows) for each query: descend to the longest prefixes, then ascend in all trees at once."""
        wanted = min(wanted, self.n)
        for lo in range(0, len(q), step):
            own = [self.codes(q[lo : lo + step], p) for p in self.planes]
            n = len(own[0])
            # descend: how many trailing signs each tree gives up for its longest match, next to the query's place
            given = np.full(n, self.bits)
            for c, s in zip(own, self.sorted, strict=True):
                at = np.searchsorted(s, c)
                for beside in (s[np.maximum(at - 1, 0)], s[np.minimum(at, self.n - 1)]):
                    given = np.minimum(given, np.frexp((c ^ beside).astype(np.float64))[1])
            active = np.arange(n)
            there = np.zeros(self.n, bool)
            for drop in range(int(given.min()), self.bits + 1):  # ascend: a sign less at a time, in every tree
                now = active[given[active] <= drop]
                spans = []
                for c, s in zip(own, self.sorted, strict=True):
                    low = c[now] >> drop << drop
                    spans.append((np.searchsorted(s, low, "left"), np.searchsorted(s, low + (1 << drop), "left")))
                enough = sum(b - a for a, b in spans) >= wanted  # with repeats: fewer cannot do
                done = []
                for i in np.flatnonzero(enough).tolist():
                    there[:] = False
                    for (a, b), order in zip(spans, self.order, strict=True):
                        there[order[a[i] : b[i]]] = True
                    near = np.flatnonzero(there)
                    if len(near) >= wanted:
                        done.append(now[i])
                        yield lo + int(now[i]), near
                active = np.setdiff1d(active, done)
                if not len(active):
                    break


def nearest(q: np.ndarray, q_norm: float, x: np.ndarray, norms: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the ``n`` best rows, ties to the smaller id. A first product finds all that may be among them;
    their scores are summed row by row in one order, so that equal vectors have equal scores."""
    rough = x @ q / (norms * q_norm)
    if len(rough) > n:
        few = np.flatnonzero(rough >= np.partition(rough, -n)[-n] - 1e-9)
        x, norms, ids = x[few], norms[few], ids[few]
    score = (x * q).sum(1) / (norms * q_norm)
    top = np.lexsort((ids, -score))[:n]
    return ids[top], score[top]


def search(table: DataFrame, queries: DataFrame, n: int = 5, key: str = "vec_id", vector: str = "embedding", trees: int = 128, bits: int = 52, shard_rows: int = 8192, block: int = 16_384, power: float = 0.86) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``n`` nearest found for each row of ``queries`` among ``table``.

    The ascent in a shard of m rows stops at m ** ``power`` candidates (a growing number, but a shrinking share), and at
    16 ``n`` at least."""
    rows = usable(table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")), "vector").where("id is not null")
    asked = usable(queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")), "vector").where("id is not null")
    shards, blocks = (max(1, -(-df.count() // most)) for df, most in ((rows, shard_rows), (asked, block)))
    dims = F.size("vector").alias("dims")
    own = rows.select(dims, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "id", "vector")
    ask = asked.select(dims, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"), "id", "vector")

    def run(batches):
        import pyarrow as pa

        for _, t in groups(batches, ["dims", "shard", "block"]):
            asks, ids = t.column("asks").to_numpy(), t.column("id").to_numpy(zero_copy_only=False)
            x = matrix(t.column("vector"))
            base, q = np.flatnonzero(~asks), np.flatnonzero(asks)
            if not len(base) or not len(q):
                continue
            scaled = x / np.abs(x).max(1, keepdims=True)  # no square overflows
            norm = np.sqrt((scaled * scaled).sum(1))
            forest = Forest(scaled[base] / norm[base, None], trees, bits)
            found = ([], [], [])
            for i, near in forest.candidates(scaled[q] / norm[q, None], max(16 * n, int(len(base) ** power))):
                near = base[near]
                near = near[ids[near] != ids[q[i]]]
                who, score = nearest(scaled[q[i]], norm[q[i]], scaled[near], norm[near], ids[near], n)
                found[0].append(np.full(len(who), ids[q[i]]))
                found[1].append(who)
                found[2].append(score)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    keys = ["dims", "shard", "block"]
    found = own.unionByName(ask).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")
