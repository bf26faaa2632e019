"""Suffix-array dedup: every byte under a string of ``length`` bytes that also starts in a document of smaller id goes.

Two equal strings of ``length`` bytes share the place of their smallest hashed k-gram, their anchor. So suffixes are
sorted at anchors only, and only at those whose k-gram stands in two documents or more:

1. each task sends its anchors' k-gram hashes, sorted and packed; where a hash meets another document, its places survive;
2. the suffixes at surviving places, with the bytes before them, are sorted in each task into runs, front-coded
   (common prefix with the one before, then the rest) and exchanged by ranges of their first bytes;
3. a loser tree merges the runs of a range. Each node keeps the common prefix of its loser with the winner, so prefixes
   that are known are never compared again, and the tree's output carries the common prefix of neighbours;
4. neighbours that share the k-gram are judged: a suffix with r bytes after and l bytes before the anchor in common with
   one of a smaller document, l + r >= length, loses those bytes.

A run holds a context once (of its smallest document), so a passage in very many documents is not gathered anywhere; the
k-grams with more than ``crowd`` different contexts are judged by sums over all tasks instead. Copies of a whole text
are settled by their digest first.

Defined results: a null text is empty; a null id counts as larger than all; rows of equal id are never compared, so
repeated rows lose nothing to each other; a text of fewer than ``length`` bytes loses nothing; extra columns are not
looked at; an empty table gives an empty one. Texts are taken whole and as UTF-8 bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import groups
from .common import drop_stored, pack, release, store, unpack

LENGTH, GRAM = 50, 22
WIDTH = LENGTH - GRAM + 1  # k-grams in a string
BEFORE = WIDTH - 1  # bytes that may stand before an anchor in a string
KEY = LENGTH + BEFORE + 2  # of a sort key: bytes after, bytes before (backwards), how many of either
BITS = 44  # of a k-gram's hash, as exchanged
LAST = (1 << 63) - 1
_BYTE = np.random.default_rng(50).integers(1 << 62, size=256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, put together from halves, quarters and so on."""
    power = {1: _BYTE[data]}
    step, n = 1, _ODD
    factor = {1: n}
    while step * 2 <= GRAM:
        h = power[step]
        with np.errstate(over="ignore"):
            power[step * 2] = h[: len(h) - step] * factor[step] + h[step:]
            factor[step * 2] = factor[step] * factor[step]
        step *= 2
    at, out = step, power[step]
    for s in sorted(power, reverse=True):
        if at + s <= GRAM:
            m = len(data) - (at + s) + 1
            out = out[:m] * factor[s] + power[s][at : at + m]
            at += s
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(data: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all strings within texts that end at ``ends``, ``most`` strings at a time: a
    place within a stretch fits the low bits beside the hash, however long the text."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found = []
    for lo in range(0, n, most):
        hi = min(lo + most, n)
        own = ends[np.searchsorted(ends, lo, side="right") : np.searchsorted(ends, hi + LENGTH, side="left")] - lo
        at, h = _anchors(data[lo : hi + LENGTH - 1], own)
        found.append((at + lo, h))
    at, h = (np.concatenate(c) for c in zip(*found, strict=True))
    new = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
    return at[new], h[new]


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = gram_hashes(data)
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # smallest hash, then first place
    span = 1
    while span * 2 <= WIDTH:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < WIDTH:
        low = np.minimum(low[: len(low) - (WIDTH - span)], low[WIDTH - span :])
    inside = np.ones(len(low), bool)
    for e in ends.tolist():  # strings that would cross an end
        inside[max(0, e - LENGTH + 1) : max(0, e)] = False
    at = (low[inside] & np.uint64(0xFFFFFF)).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return at, h[at] >> np.uint64(64 - BITS)


def slices(batches, most: int = 1_000_000) -> Iterator[tuple[list, list, list[bytes]]]:
    """(ids, tids, texts as bytes) of batches, about ``most`` bytes at a time."""
    for b in batches:
        docs, tids, texts, n = [], [], [], 0
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            for d, i, t in zip(part.column("doc").to_pylist(), part.column("tid").to_pylist(), part.column("text").to_pylist(), strict=True):
                docs.append(d)
                tids.append(i)
                texts.append(t.encode())
                n += len(texts[-1])
                if n >= most:
                    yield docs, tids, texts
                    docs, tids, texts, n = [], [], [], 0
        if docs:
            yield docs, tids, texts
    release()


def bounds(parts: int) -> np.ndarray:
    """The least hashes of the parts 1, 2, ...: as many anchors in each. An anchor is the least hash of its string, so small
    hashes are far more frequent: with q = 1 - x, a share of 1 - 15 q^29 + 14 q^30 of them (for ``WIDTH`` 29) is below x."""
    goal = np.arange(1, parts) / parts
    lo, hi = np.zeros(parts - 1), np.ones(parts - 1)
    for _ in range(BITS):
        mid = (lo + hi) / 2
        q = 1 - mid
        below = 1 - (WIDTH + 1) / 2 * q**WIDTH + (WIDTH - 1) / 2 * q ** (WIDTH + 1) < goal
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return np.maximum.accumulate((hi * (1 << BITS)).astype(np.uint64))


def meeting_places(texts: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(doc, tid, at array<int>): the anchors of each text whose k-gram stands in another document too; and the stored
    table of anchors that it is read from."""
    ranges = bounds(parts)

    def send(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = [("part", pa.int32()), ("block", pa.binary()), ("run", pa.int64()), ("docs", pa.list_(pa.int64())), ("tids", pa.list_(pa.int64())), ("local", pa.int32()), ("at", pa.list_(pa.int32()))]
        held: list[tuple] = []
        names: tuple[list, list] = ([], [])
        run = TaskContext.get().partitionId() << 32

        def flush():
            h, who, at = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.lexsort((at, who, h))
            h, who, at = h[order], who[order], at[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            lo, hi = who[new], who[np.concatenate([np.flatnonzero(new)[1:], [len(h)]]) - 1]
            here = (lo < hi)[np.cumsum(new) - 1]  # met within this task: its places survive at once
            rows = {k: [] for k, _ in kinds}

            def add(**row):
                for k in rows:
                    rows[k].append(row.get(k))

            add(run=run, docs=list(names[0]), tids=list(names[1]))
            o = np.flatnonzero(here)
            o = o[np.argsort(who[o], kind="stable")]
            cut = np.flatnonzero(np.diff(who[o], prepend=-1)).tolist()
            for s, e in zip(cut, [*cut[1:], len(o)], strict=bool(cut)):
                add(run=run, local=who[o[s]], at=at[o[s:e]])
            sent = ~here | new  # one of a group that has met is enough for others
            h, who, at = h[sent], who[sent], at[sent]
            edges = np.concatenate([[0], np.searchsorted(h, ranges), [len(h)]])
            for p in range(parts):
                s, e = edges[p], edges[p + 1]
                if s < e:
                    add(part=p, block=pack(h[s:e], who[s:e].astype(np.uint64), at[s:e].astype(np.uint64)), run=run)
            held.clear()
            names[0].clear()
            names[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in kinds], [k for k, _ in kinds])

        n = 0
        for docs, tids, raw in slices(batches):
            ends = np.cumsum([len(t) for t in raw])
            at, h = anchors(np.frombuffer(b"".join(raw), np.uint8), ends)
            who = np.searchsorted(ends, at, side="right")
            held.append((h, who + len(names[0]), at - np.concatenate([[0], ends])[who]))
            names[0].extend(docs)
            names[1].extend(tids)
            n += len(at)
            if n > 400_000:
                yield flush()
                n, run = 0, run + 1
        if n:
            yield flush()

    sent = store(texts.mapInArrow(send, "part int, block binary, run long, docs array<long>, tids array<long>, local int, at array<int>"), "anchors")

    def meet(batches):
        import pyarrow as pa

        for _, t in groups(batches, ["part"]):
            names = t.column("run").to_numpy()
            cols: tuple[list, ...] = ([], [], [], [])
            for k, block in enumerate(t.column("block")):
                h, local, at = unpack(block.as_py(), 3)
                for col, x in zip(cols, (h, np.full(len(h), k, np.int32), local.astype(np.int32), at.astype(np.int32)), strict=True):
                    col.append(x)
            del t
            h, which, local, at = map(np.concatenate, cols)
            del cols
            order = np.argsort(h, kind="stable")
            h = h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            many = np.diff(first, append=len(h))
            del h
            a, b = order[first], order[first + many - 1]
            # a run's rows stand together, by text: the ends of a group tell whether it holds two texts
            keep = order[np.repeat((which[a] != which[b]) | (local[a] != local[b]), many)]
            yield pa.RecordBatch.from_arrays([pa.array(names[which[keep]]), pa.array(local[keep]), pa.array(at[keep])], ["run", "local", "at"])
        release()

    far = sent.where("part is not null").select("part", "block", "run").repartition(parts, "part").sortWithinPartitions("part", "run").mapInArrow(meet, "run long, local int, at int")
    far = far.groupBy("run", "local").agg(F.collect_list("at").alias("at"))
    near = sent.where("part is null and local is not null").select("run", "local", "at")
    names = sent.where("docs is not null").select("run", F.posexplode(F.arrays_zip("docs", "tids")).alias("local", "x")).select("run", "local", F.col("x.docs").alias("doc"), F.col("x.tids").alias("tid"))
    every = far.unionByName(near).groupBy("run", "local").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    return every.join(names, ["run", "local"]).groupBy("doc", "tid").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")), sent


def keys_of(data: np.ndarray, ends: np.ndarray, who: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sort keys (rows of bytes) of the suffixes at places ``at`` of the joined texts."""
    begin = np.concatenate([[0], ends])[who]
    after, before = np.minimum(ends[who] - at, LENGTH), np.minimum(at - begin, BEFORE)
    out = np.zeros((len(at), KEY), np.uint8)
    i = np.arange(LENGTH)
    out[:, :LENGTH] = np.where(i < after[:, None], data[np.minimum(at[:, None] + i, len(data) - 1)], 0)
    i = np.arange(BEFORE)
    out[:, LENGTH : LENGTH + BEFORE] = np.where(i < before[:, None], data[np.maximum(at[:, None] - 1 - i, 0)], 0)
    out[:, -2], out[:, -1] = after, before
    return out


def front_code(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys as common prefix with the one before and the rest; other columns beside them."""
    import zstandard

    n = len(keys)
    same = np.zeros((n, KEY + 1), bool)
    same[1:, :KEY] = keys[1:] == keys[:-1]
    common = same.argmin(1).astype(np.uint8)
    rest = keys[np.arange(KEY) >= common[:, None]].tobytes()
    planes = [np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([struct.pack("<q", n), common.tobytes(), *planes, rest]))


def front_decode(block: bytes, columns: int) -> tuple[list[bytes], list[int], list[list[int]]]:
    """(keys, common prefixes, columns) of a block."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    (n,) = struct.unpack("<q", raw[:8])
    common = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    o = 8 + n
    cols = [np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * 8, o + i * n * 8).reshape(8, n).T).view("<i8").ravel().tolist() for i in range(columns)]
    rest = np.frombuffer(raw, np.uint8, offset=o + columns * n * 8)
    start = np.cumsum(KEY - common) - (KEY - common) - common  # of a row's byte 0, were it there
    c = np.arange(KEY)
    owner = np.maximum.accumulate(np.where(common[:, None] <= c, np.arange(n)[:, None], 0), axis=0)
    whole = rest[start[owner] + c].tobytes()
    return [whole[i : i + KEY] for i in range(0, n * KEY, KEY)], common.tolist(), cols


class Run:
    """A sorted run, decoded a block at a time."""

    __slots__ = ("blocks", "keys", "common", "cols", "at", "n")

    def __init__(self, blocks: list[bytes]):
        self.blocks = blocks[::-1]
        self.n, self.at = 0, -1

    def step(self) -> int:
        """Go on; the common prefix with the key before (0 at the first of a block), -1 at the end."""
        self.at += 1
        if self.at < self.n:
            return self.common[self.at]
        if not self.blocks:
            return -1
        last = self.keys[-1] if self.n else None
        self.keys, self.common, self.cols = front_decode(self.blocks.pop(), 3)
        self.at, self.n = 0, len(self.keys)
        return common_prefix(last, self.keys[0], 0) if last else 0


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    if a == b:
        return len(a)
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def merge(runs: list[Run]) -> Iterator[tuple[bytes, int, int, int, int]]:
    """(key, common prefix with the key before, three columns) of all runs in order, by a loser tree."""
    size = 1
    while size < len(runs):
        size *= 2
    heads = [r.step() for r in runs] + [-1] * (size - len(runs))
    loser, prefix = [0] * size, [0] * size

    def play(s: int, h: int, node: int) -> tuple[int, int]:
        """The winner of (s, h) against the loser kept at ``node``, which then keeps the other."""
        s2, h2 = loser[node], prefix[node]
        if h > h2:
            return s, h
        if h < h2:
            loser[node], prefix[node] = s, h
            return s2, h2
        if h < 0:
            return s, h
        a, b = runs[s], runs[s2]
        x, y = a.keys[a.at], b.keys[b.at]
        if x <= y:
            prefix[node] = common_prefix(x, y, h)
            return s, h
        loser[node], prefix[node] = s, common_prefix(x, y, h)
        return s2, h2

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, min(heads[node - size], 0)
        left, right = build(2 * node), build(2 * node + 1)
        loser[node], prefix[node] = right
        return play(*left, node)

    s, h = build(1) if size > 1 else (0, min(heads[0], 0))
    while h >= 0:
        r = runs[s]
        c = r.cols
        i = r.at
        yield r.keys[i], h, c[0][i], c[1][i], c[2][i]
        h, node = r.step(), (s + size) >> 1
        while node:
            s2, h2 = loser[node], prefix[node]
            if h < h2:
                loser[node], prefix[node] = s, h
                s, h = s2, h2
            elif h == h2:
                s, h = play(s, h, node)
            node >>= 1


Entry = tuple[bytes, int, list[tuple[int, int]]]  # key, smallest id, its (tid, place)s


def judge(entries: list[Entry], common: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(id, tid, start, end) of what goes, among different contexts of one k-gram; ``common[i]``: of i - 1 and i."""
    if len(entries) <= 16:
        for i, (x, doc, places) in enumerate(entries):
            lo = hi = 0
            for way in (-1, 1):
                r, j = LENGTH, i
                while 0 <= j + way < len(entries):
                    r = min(r, common[j if way < 0 else j + 1])
                    j += way
                    if r < GRAM:
                        break
                    y, other, _ = entries[j]
                    if other >= doc:
                        continue
                    right = min(r, x[-2], y[-2])
                    left = min(common_prefix(x[LENGTH:-2], y[LENGTH:-2], 0), x[-1], y[-1])
                    if left + right >= LENGTH:
                        lo, hi = max(lo, left), max(hi, right)
            if hi:
                for tid, at in places:
                    yield doc, tid, at - lo, at + hi
        return
    m = np.frombuffer(b"".join([e[0] for e in entries]), np.uint8).reshape(-1, KEY)
    docs = np.array([e[1] for e in entries])
    text = np.concatenate([m[:, LENGTH : LENGTH + BEFORE][:, ::-1], m[:, :LENGTH]], axis=1)
    after, before = m[:, -2].astype(int), m[:, -1].astype(int)
    lo, hi = np.full(len(m), -1), np.full(len(m), LENGTH)
    for o in range(BEFORE + 1):
        own = np.flatnonzero((before >= o) & (after >= LENGTH - o))
        if len(own) < 2:
            continue
        window = np.ascontiguousarray(text[own, BEFORE - o : BEFORE - o + LENGTH]).view(f"V{LENGTH}").ravel()
        _, kind = np.unique(window, return_inverse=True)
        least = np.full(kind.max() + 1, LAST)
        np.minimum.at(least, kind, docs[own])
        gone = own[docs[own] > least[kind]]
        lo[gone] = o
        hi[gone] = np.minimum(hi[gone], o)
    for i in np.flatnonzero(lo >= 0).tolist():
        for tid, at in entries[i][2]:
            yield int(docs[i]), tid, at - int(lo[i]), at - int(hi[i]) + LENGTH


def whole(key: bytes, at: int) -> tuple[int, int] | None:
    """The bytes under all strings of a context, if it holds one."""
    return (at - key[-1], at + key[-2]) if key[-1] + key[-2] >= LENGTH else None


def removed(texts: DataFrame, places: DataFrame, splits: np.ndarray, parts: int, crowd: int) -> DataFrame:
    """(doc, tid, a, b): spans of bytes that go, from the suffixes at the stored ``places``, which go once they are read."""
    joined = texts.join(places, ["doc", "tid"])

    def sort(batches):
        import pyarrow as pa

        kinds = [("part", pa.int32()), ("run", pa.int64()), ("seq", pa.int32()), ("block", pa.binary()), ("doc", pa.int64()), ("tid", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]
        from pyspark import TaskContext

        held, n, run = [], 0, 0
        base = TaskContext.get().partitionId() << 32

        def flush():
            keys = np.concatenate([x[0] for x in held])
            docs, tids, at = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            raw = keys.tobytes()
            order = np.array(sorted(range(len(keys)), key=lambda i, d=docs.tolist(): (raw[i * KEY : (i + 1) * KEY], d[i])))
            keys, docs, tids, at = keys[order], docs[order], tids[order], at[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]).any(1)
            first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            rows = {k: [] for k, _ in kinds}
            more = docs > docs[first]  # the same context in a smaller document of this run
            for i in np.flatnonzero(more).tolist():
                if span := whole(keys[i].tobytes(), int(at[i])):
                    for k, v in zip(rows, (None, None, None, None, docs[i], tids[i], *span), strict=True):
                        rows[k].append(v)
            keys, docs, tids, at = keys[~more], docs[~more], tids[~more], at[~more]
            part = np.searchsorted(splits, np.ascontiguousarray(keys[:, :GRAM]).view(f"S{GRAM}").ravel(), side="right")
            edges = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                for q, s in enumerate(range(edges[p], edges[p + 1], 4000)):
                    e = min(s + 4000, edges[p + 1])
                    for k, v in zip(rows, (p, base + run, q, front_code(keys[s:e], docs[s:e], tids[s:e], at[s:e]), None, None, None, None), strict=True):
                        rows[k].append(v)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in kinds], [k for k, _ in kinds])

        for b in batches:
            for lo in range(0, b.num_rows, 50):
                part = b.slice(lo, 50)
                docs, tids, raw = (part.column(c).to_pylist() for c in ("doc", "tid", "text"))
                raw = [t.encode() for t in raw]
                ends = np.cumsum([len(t) for t in raw])
                data = np.frombuffer(b"".join(raw), np.uint8)
                own = part.column("at")
                many = np.diff(own.offsets.to_numpy())
                whose, spot = np.repeat(np.arange(len(many)), many), own.flatten().to_numpy().astype(np.int64)
                begin = np.concatenate([[0], ends])
                docs, tids = np.array(docs, np.int64), np.array(tids, np.int64)
                for s in range(0, len(spot), 30_000):  # so many keys at a time, however long a text
                    who, place = whose[s : s + 30_000], spot[s : s + 30_000]
                    held.append((keys_of(data, ends, who, place + begin[who]), docs[who], tids[who], place))
                    n += len(place)
                    if n > 120_000:
                        yield flush()
                        n, run = 0, run + 1
        if n:
            yield flush()
        release()

    sent = store(joined.mapInArrow(sort, "part int, run long, seq int, block binary, doc long, tid long, a int, b int"), "runs", free=True)
    drop_stored(places)

    def sweep(batches):
        import pyarrow as pa

        names = ["doc", "tid", "a", "b", "key"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for _, t in groups(batches, ["part"]):
            blocks: dict[int, list[bytes]] = {}
            for r, x in zip(t.column("run").to_pylist(), t.column("block").to_pylist(), strict=True):
                blocks.setdefault(r, []).append(x)
            out: list[tuple] = []
            entries: list[Entry] = []
            common: list[int] = []
            over = False

            def close():
                nonlocal over
                if over:
                    out.extend((doc, tid, at, None, key) for key, doc, places in entries for tid, at in places)
                elif len(entries) > 1:
                    out.extend((*x, None) for x in judge(entries, common))
                entries.clear()
                common.clear()

            def rows():
                cols = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names)

            same: list[tuple[int, int, int]] = []  # of the key at hand; one of each run at most, and rows of its id

            def settle(key: bytes, h: int):
                nonlocal over
                doc = min(x[0] for x in same)
                for d, tid, at in same:
                    if d > doc and (span := whole(key, at)):
                        out.append((d, tid, *span, None))
                if h < GRAM:
                    close()
                    over = False
                entries.append((key, doc, [(t_, a_) for d, t_, a_ in same if d == doc]))
                common.append(h)
                if len(entries) >= crowd:  # too many to hold: they leave for the sums over all tasks
                    over = True
                    close()
                same.clear()

            last, lead = None, 0
            for key, h, doc, tid, at in merge([Run(x) for x in blocks.values()]):
                if h < KEY and last is not None:
                    settle(last, lead)
                    lead = h
                last = key
                same.append((doc, tid, at))
                if len(out) > 50_000:
                    yield rows()
            if last is not None:
                settle(last, lead)
            close()
            yield rows()

    far = sent.where("part is not null").select("part", "run", "seq", "block").repartition(parts, "part").sortWithinPartitions("part", "run", "seq")
    near = sent.where("part is null").select("doc", "tid", "a", "b", F.lit(None).cast("binary").alias("key"))
    swept = store(far.mapInArrow(sweep, "doc long, tid long, a int, b int, key binary").unionByName(near), "swept", free=True)
    drop_stored(sent)
    out = swept.where("key is null").select("doc", "tid", "a", "b")
    crowded = swept.where("key is not null")
    if not crowded.isEmpty():
        out = out.unionByName(judge_crowds(crowded))
    return out


def judge_crowds(crowded: DataFrame) -> DataFrame:
    """(doc, tid, a, b) among the contexts of crowded k-grams: each string with its smallest id, over all tasks."""
    ahead = F.expr(f"reverse(hex(substring(key, {LENGTH + 1}, {BEFORE})))")  # nibbles backwards: turned alike for all
    row = crowded.select("doc", "tid", "a", F.expr(f"hex(substring(key, 1, {LENGTH}))").alias("after"), ahead.alias("before"), F.expr(f"cast(conv(hex(substring(key, {KEY - 1}, 1)), 16, 10) as int)").alias("n_after"), F.expr(f"cast(conv(hex(substring(key, {KEY}, 1)), 16, 10) as int)").alias("n_before"))
    each = row.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(BEFORE)))).where(f"n_before >= o and n_after >= {LENGTH} - o")
    each = each.withColumn("string", F.md5(F.concat(F.expr(f"substring(before, {2 * BEFORE} - 2 * o + 1, 2 * o)"), F.lit("|"), F.expr(f"substring(after, 1, 2 * ({LENGTH} - o))"))))
    each = each.select("doc", "tid", "a", "o", "string")
    least = each.groupBy("o", "string").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    return each.join(least, ["o", "string"]).where("doc > least").select("doc", "tid", (F.col("a") - F.col("o")).alias("a"), (F.col("a") - F.col("o") + LENGTH).alias("b"))


def split_points(texts: DataFrame, digests: DataFrame, parts: int, most: int = 400, each: int = 64) -> np.ndarray:
    """First k-grams of the ranges 1, 2, ...: quantiles over ``each`` anchors of at most ``most`` texts (of those with an
    anchor, by hash), so at most most * each * GRAM bytes come to the driver. A range never splits a k-gram. Only which
    task does what depends on them, never a result."""
    tids = [r.tid for r in digests.where(f"n >= {LENGTH}").select("tid").distinct().orderBy("tid").limit(most).collect()]

    def leads(batches):
        import pyarrow as pa

        for _, _, raw in slices(batches):
            own = []
            for t in raw:
                data = np.frombuffer(t, np.uint8)
                at = anchors(data, np.array([len(t)]))[0]
                at = at[np.unique(np.linspace(0, len(at) - 1, each).astype(int))] if len(at) else at
                own.append([t[i : i + GRAM] for i in at.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.binary()))], ["leads"])

    drawn = texts.where(F.col("tid").isin(tids)).select("doc", "tid", "text").dropDuplicates(["tid"]) if tids else texts.limit(0)
    found = drawn.mapInArrow(leads, "leads array<binary>").collect()  # ``most`` rows at most
    lead = np.sort(np.array([bytes(x) for r in found for x in r.leads] or [b""], f"S{GRAM}"))
    return lead[(np.arange(1, parts) * len(lead)) // parts]


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", crowd: int = 20_000, part_bytes: int = 10_000_000, salts: int = 8) -> DataFrame:
    """(key, tid, text, starts, ends): every row of ``docs`` with the maximal spans of bytes that go from its text.

    Anchors and suffixes meet in as many parts as there are ``part_bytes`` of text; a task holds one part at a time."""
    doc = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(doc.alias("doc"), body.alias("text")).withColumn("tid", F.xxhash64("doc", "text"))
    # whole copies of a text in a smaller document
    digests = store(texts.select("doc", "tid", F.md5("text").alias("digest"), F.octet_length("text").alias("n")), "digests")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(digests.agg(F.sum("n")).first()[0] or 1) // part_bytes))
    first = digests.where(f"n >= {LENGTH}").groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    # a digest may have a third of all rows: each goes to one of ``salts`` places, where its smallest id is, too
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = digests.where(f"n >= {LENGTH}").withColumn("salt", F.pmod(F.xxhash64("tid"), F.lit(salts)).cast("int"))
    copies = store(salted.join(first, ["digest", "salt"]).where("doc > first").select("doc", "tid", F.lit(0).alias("a"), F.col("n").cast("int").alias("b")), "copies").dropDuplicates(["doc", "tid"])
    own = texts.select("doc", "tid", "text")
    places, spent = meeting_places(own, parts)
    places = store(places.join(copies.select("doc", "tid"), ["doc", "tid"], "left_anti"), "places", free=True)
    drop_stored(spent)
    spans = removed(own, places, split_points(own, digests, parts), parts, crowd).unionByName(copies)
    by_doc = spans.groupBy("doc", "tid").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))

    def settle(batches):
        import pyarrow as pa

        for b in batches:
            starts, ends = [], []
            for own in b.column("spans").to_pylist():
                s, e = [], []
                for x in own or []:
                    if e and x["a"] <= e[-1]:
                        e[-1] = max(e[-1], x["b"])
                    else:
                        s.append(x["a"])
                        e.append(x["b"])
                starts.append(s)
                ends.append(e)
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tid"), pa.array(starts, ints), pa.array(ends, ints)], ["doc", "tid", "starts", "ends"])

    by_doc = by_doc.mapInArrow(settle, "doc long, tid long, starts array<long>, ends array<long>")
    none = F.array().cast("array<long>")
    out = texts.join(by_doc, ["doc", "tid"], "left")
    return out.select(F.nullif("doc", F.lit(LAST)).alias(key), "tid", "text", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"))


def digest(deduped: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of what ``dedup`` returns."""
    ahead = F.concat(F.array(F.lit(0).cast("long")), "ends")
    behind = F.concat("starts", F.array("n_bytes"))
    raw = F.encode("text", "utf-8")
    kept = F.concat_ws("", F.zip_with(ahead, behind, lambda a, b: F.hex(F.substring("raw", a.cast("int") + 1, (b - a).cast("int")))))
    rows = deduped.withColumns({"raw": raw, "n_bytes": F.octet_length("text").cast("long")})
    removed_ = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return rows.select(key, "n_bytes", removed_.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.when(F.size("starts") == 0, F.sha2("raw", 256)).otherwise(F.sha2(F.unhex(kept), 256)).alias("kept_sha256"))
