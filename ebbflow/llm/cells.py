"""Groups of any size compared within themselves, in square cells of bounded size.

A group of n members is dealt over c = ceil(n / block) chunks; each pair of chunks is a cell, and each member goes to the
c cells of its chunk. A task holds one cell at a time, whatever the size of the group, and returns counts and a spanning
forest rather than pairs. A cell of two chunks returns only the edges that join what the chunks' own cells leave apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release


def groups(batches, keys: list[str]) -> Iterator[tuple[tuple, object]]:
    """(key, Arrow table) of each group, from batches sorted by ``keys``."""
    import pyarrow as pa

    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[s] for c in cols)
            if key != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                now, held = key, []
            held.append(b.slice(s, e - s))
    if held:
        yield now, pa.Table.from_batches(held)
    del held
    release()


def forest(adj: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    seen, out = np.zeros(len(adj), bool), []
    for s in np.flatnonzero(adj.any(1)).tolist():
        if seen[s]:
            continue
        seen[s], stack = True, [s]
        while stack:
            u = stack.pop()
            new = np.flatnonzero(adj[u] & ~seen).tolist()
            seen[new] = True
            out += [(u, v) for v in new]
            stack += new
    return out


def bridges(square: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges between the first ``n`` and the rest that join components which the cells of either chunk leave apart."""
    own = square.copy()
    np.fill_diagonal(own, False)
    own[:n, n:] = own[n:, :n] = False
    root = np.arange(len(square))

    def top(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = int(root[v])
        return v

    for a, b in forest(own):
        root[top(b)] = top(a)
    label = np.array([top(v) for v in range(len(square))])
    a, b = np.nonzero(square[:n, n:])
    _, first = np.unique(label[a] * len(square) + label[b + n], return_index=True)
    out = []
    for k in first.tolist():
        x, y = top(int(a[k])), top(int(b[k]) + n)
        if x != y:
            root[y] = x
            out.append((int(a[k]), int(b[k]) + n))
    return out


def deal(members: DataFrame, group: str, size: str, member: str, block: int) -> DataFrame:
    """``members`` with their cells: columns ``i`` <= ``j`` and the member's own chunk ``k``."""
    c = F.ceil(F.col(size) / F.lit(block)).cast("int")
    out = members.withColumn("k", F.pmod(F.xxhash64(member, F.lit(block)), c).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), c - 1)))
    return out.withColumns({"i": F.least("k", "other"), "j": F.greatest("k", "other")}).drop("other", size)


def compare(dealt: DataFrame, group: str, member: str, weight: str | None, similar: Callable[[object, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b, n) of all cells: for each member a with links its sum of weights over the cell (b null), and the edges of
    a spanning forest (n null). ``similar(table, rows, columns)`` gives the boolean matrix between members, by place."""

    def run(batches):
        import pyarrow as pa

        for (_, i, j), t in groups(batches, [group, "i", "j"]):
            ids, k = t.column(member).to_numpy(), t.column("k").to_numpy()
            _, first = np.unique(ids, return_index=True)  # a member that comes twice counts once
            left, right = first[k[first] == i], first[k[first] == j]
            if not len(left) or not len(right) or i == j and len(left) < 2:
                continue
            w = np.ones(len(ids), np.int64) if weight is None else t.column(weight).to_numpy()
            if i == j:
                hit = similar(t, left, left)
                np.fill_diagonal(hit, False)
                counts, own = hit @ w[left], ids[left]
                edges = [(left[a], left[b]) for a, b in forest(hit)]
            else:
                n, both = len(left), np.concatenate([left, right])
                square = similar(t, both, both)
                hit = square[:n, n:]
                counts, own = np.concatenate([hit @ w[right], hit.T @ w[left]]), ids[both]
                edges = [(both[a], both[b]) for a, b in bridges(square, n)]
            some = counts > 0
            if not some.any():
                continue
            a = np.concatenate([own[some], ids[[e[0] for e in edges]]])
            b = [None] * int(some.sum()) + ids[[e[1] for e in edges]].tolist()
            n = counts[some].tolist() + [None] * len(edges)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    keys = [group, "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, n long")
