"""Byte-level BPE: pre-tokenisation by class arrays and an associative scan, then cached pair merging.

The split pattern is run as a small automaton. Each code point becomes a symbol (letter, number, other sign, space,
white space, apostrophe that may open a contraction, end of text). Each symbol is a function from states to states, and
functions compose associatively: the text is cut into blocks, every block's function is found for all states at once
with one array operation per column, the block functions are composed in order, and a second sweep with the known first
state of each block yields the token starts. No regular expression runs over the text.

Defined results: a null text is an empty one (no ids); repeated rows each give a row; other columns are left out, so
names cannot clash; an empty table gives an empty one. Very long pieces are merged with a heap, in n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_rows

L, N, O, A2, A3, SP_LAST, SP, WS_LAST, WS, END = range(10)
FRESH, IN_L, IN_N, IN_O, IN_SP, IN_WS, LEFT1, LEFT2 = range(8)
#: The code points of the Unicode property White_Space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NO_CHAR = 0x110000
NO_MERGE = 1 << 40


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a token start here), each indexed by symbol * 8 + state."""
    step, start = np.zeros((10, 8), np.uint8), np.ones((10, 8), np.uint8)
    for sym, own in ((L, IN_L), (N, IN_N), (O, IN_O)):
        step[sym] = own
        start[sym, [own, IN_SP]] = 0
    step[L, LEFT1], step[L, LEFT2] = FRESH, LEFT1
    start[L, [LEFT1, LEFT2]] = 0
    for sym, left in ((A2, LEFT1), (A3, LEFT2)):
        step[sym] = left
        step[sym, [IN_O, IN_SP]] = IN_O
        start[sym, [IN_O, IN_SP]] = 0
    for sym, own in ((SP_LAST, IN_SP), (SP, IN_SP), (WS_LAST, IN_WS), (WS, IN_WS)):
        step[sym] = own
    start[SP, [IN_SP, IN_WS]] = start[WS, [IN_SP, IN_WS]] = 0
    step[END] = FRESH
    return step.ravel(), start.ravel()


STEP, START = automaton()


class Classes:
    """Class of each code point, found when first seen: L, N, O, SP or WS, and END for no character."""

    def __init__(self):
        self.table = np.full(NO_CHAR + 1, 255, np.uint8)
        self.table[WHITE] = WS
        self.table[0x20], self.table[NO_CHAR] = SP, END

    def of(self, cps: np.ndarray) -> np.ndarray:
        out = self.table[cps]
        if (out == 255).any():
            for c in np.unique(cps[out == 255]).tolist():
                self.table[c] = {"L": L, "N": N}.get(unicodedata.category(chr(c))[0], O)
            out = self.table[cps]
        return out


def symbols(cps: np.ndarray, classes: Classes) -> np.ndarray:
    """Symbols of code points; texts end with NO_CHAR."""
    sym = classes.of(cps)
    white = (sym == SP) | (sym == WS)
    follows = np.zeros(len(sym), bool)
    follows[:-1] = ~white[1:] & (sym[1:] != END)
    sym[white & follows] -= 1  # SP to SP_LAST, WS to WS_LAST
    at = np.flatnonzero(cps == 39)
    if len(at):
        one, two = cps[np.minimum(at + 1, len(cps) - 1)], cps[np.minimum(at + 2, len(cps) - 1)]
        sym[at[np.isin(one, [ord(c) for c in "stmd"])]] = A2
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        sym[at[pair]] = A3
    return sym


def token_starts(sym: np.ndarray, block: int = 256) -> np.ndarray:
    """True where a token or the end of a text starts."""
    rows = -(-len(sym) // block)
    grid = np.full(rows * block, END, np.uint8)
    grid[: len(sym)] = sym
    cols = np.ascontiguousarray(grid.reshape(rows, block).T) * np.uint8(8)
    f = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, axis=1)
    for c in cols:  # the function of each block: its last state for every first state
        f = STEP.take(f + c)
    state, first = FRESH, np.empty(rows, np.uint8)
    for i, own in enumerate(f.T.tolist()):  # composed over the blocks
        first[i] = state
        state = own[state]
    out, s = np.empty((block, rows), np.uint8), first
    for j, c in enumerate(cols):
        s = s + c
        out[j] = START.take(s)
        s = STEP.take(s)
    return out.T.reshape(-1)[: len(sym)].astype(bool)


def pieces(texts: list[str], classes: Classes) -> Iterator[tuple[bytes, list[int]]]:
    """For each text its UTF-8 bytes and the byte offsets of its pieces, the end included."""
    end = np.array([NO_CHAR], np.uint32)
    parts = [x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), np.uint32), end)]
    cps = np.concatenate(parts)
    starts = np.flatnonzero(token_starts(symbols(cps, classes)))
    width = (1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)).astype(np.int64)
    width[cps == NO_CHAR] = 0
    before = np.concatenate([[0], np.cumsum(width)])
    last = np.cumsum([len(p) for p in parts])[1::2] - 1  # where each text ends
    cut = np.searchsorted(starts, last)
    lo = 0
    for t, hi, e in zip(texts, cut.tolist(), last.tolist(), strict=True):
        at = before[starts[lo : hi + 1]]
        yield t.encode(), (at - before[e - len(t)]).tolist()
        lo = hi + 1


class Merger(dict):
    """Piece (bytes) to its ids as little-endian 32-bit integers; remembers about ``most`` pieces."""

    def __init__(self, ranks: dict[bytes, int], most: int = 200_000):
        super().__init__()
        self.ranks, self.most = ranks, most
        self.words = [b""] * (max(ranks.values()) + 1)
        for w, r in ranks.items():
            self.words[r] = w
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {(ranks[w[:i]] << 32) + ranks[w[i:]]: r for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()] + [NO_MERGE], np.int64)

    def learn(self, found: set[bytes]) -> None:
        """Add the ids of those pieces that aren't known: all pieces of about one length are merged at the same time."""
        if len(self) >= self.most:
            self.clear()
        groups: dict[int, list[bytes]] = {}
        for p in found.difference(self):
            if (rank := self.ranks.get(p)) is not None:
                self[p] = rank.to_bytes(4, "little")
            elif len(p) > 64:
                self[p] = np.array(self.merge_long(p), "<u4").tobytes()
            else:
                groups.setdefault(-(-len(p) // 4) * 4, []).append(p)
        for width, own in groups.items():
            for i in range(0, len(own), 20_000):
                self.merge_all(own[i : i + 20_000], width)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NO_MERGE where there is none, as for ids below 0."""
        key = (left << 32) + right
        at = np.searchsorted(self.pairs, key)
        hit = self.pairs[np.minimum(at, len(self.pairs) - 1)] == key
        return np.where(hit & (left >= 0) & (right >= 0), self.merged[at], NO_MERGE)

    def merge_all(self, own: list[bytes], width: int) -> None:
        n, cols = len(own), width + 2  # a place without id at either end
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in own]), np.uint8).reshape(n, width)
        size = np.array([len(p) for p in own])
        ids = np.full((n, cols), -1, np.int64)
        ids[:, 1:-1] = np.where(np.arange(width) < size[:, None], self.single[raw], -1)
        rank = np.full((n, cols), NO_MERGE, np.int64)
        rank[:, :-1] = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, cols - 1)
        after, ahead = np.tile(np.arange(1, cols + 1), (n, 1)), np.tile(np.arange(-1, cols - 1), (n, 1))
        rows = np.arange(n)
        while len(rows):
            i = rank[rows].argmin(1)
            best = rank[rows, i]
            go = best < NO_MERGE
            rows, i, best = rows[go], i[go], best[go]
            j = after[rows, i]
            k, h = after[rows, j], ahead[rows, i]
            ids[rows, i], ids[rows, j] = best, -1
            after[rows, i], ahead[rows, k] = k, i
            rank[rows, j] = NO_MERGE
            rank[rows, i] = self.rank_of(best, ids[rows, k])
            rank[rows, h] = self.rank_of(ids[rows, h], best)
        kept = ids >= 0
        flat, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1)) * 4
        a = 0
        for p, b in zip(own, ends.tolist(), strict=True):
            self[p] = flat[a:b]
            a = b

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a linked list and a heap of (rank, place)."""
        get, n = self.ranks.get, len(piece)
        stop, after, ahead = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive, heap = [True] * n, []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := get(piece[i : stop[j]])) is not None:
                heapq.heappush(heap, (r, i, stop[j]))

        for i in range(n):
            push(i)
        while heap:
            r, i, e = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or stop[after[i]] != e:
                continue
            j = after[i]
            alive[j], stop[i], after[i] = False, e, after[j]
            if after[j] < n:
                ahead[after[j]] = i
            push(i)
            if ahead[i] >= 0:
                push(ahead[i])
        out, i = [], 0
        while i < n:
            out.append(get(piece[i : stop[i]]))
            i = after[i]
        return out


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


_coders: dict[str, tuple[Classes, Merger]] = {}


def coder(data: bytes) -> tuple[Classes, Merger]:
    """The tables of a vocabulary, made once in each process."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _coders:
        _coders[key] = Classes(), Merger(read_ranks(data))
    return _coders[key]


def encode_texts(texts: list[str], classes: Classes, merger: Merger) -> Iterator[tuple[bytes, bytes, list[int]]]:
    """For each text its bytes, its ids (little-endian, 32 bits) and the byte offset of each of its pieces."""
    cut = []
    for raw, at in pieces(texts, classes):
        cut.append((raw, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], at))
    merger.learn(set().union(*[own for _, own, _ in cut]))
    for raw, own, at in cut:
        yield raw, b"".join(map(merger.__getitem__, own)), at


def decode_ids(ids: bytes, merger: Merger) -> bytes:
    """The bytes that ids stand for; they are the text when it was encoded with the same ranks."""
    return b"".join(map(merger.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<long>, offsets array<long>): the ids of each text, and each id's first byte in it."""
    ranks = docs.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())  # of a vocabulary file: fixed size

    def run(batches):
        import pyarrow as pa

        classes, merger = coder(ranks.value)
        widths = np.array([len(w) for w in merger.words])
        for keys, texts in arrow_rows(batches, text, key):
            ids = [np.frombuffer(i, "<u4").astype(np.int64) for _, i, _ in encode_texts(texts, classes, merger)]
            at = [np.concatenate([[0], np.cumsum(widths[i])[:-1]]) if len(i) else i for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int64()))], ["key", "ids", "offsets"])

    return docs.select(key, text).mapInArrow(run, "key long, ids array<long>, offsets array<long>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, text): what the column ``ids`` stands for; null ids are none."""
    ranks = encoded.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches):
        import pyarrow as pa

        _, merger = coder(ranks.value)
        for b in batches:
            texts = [decode_ids(np.array(x or [], "<u4").tobytes(), merger).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} long, text string")


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each text: encoded, then its ids decoded. One pass, no shuffle."""
    ranks = docs.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches):
        import pyarrow as pa

        classes, merger = coder(ranks.value)
        for keys, texts in arrow_rows(batches, text, key):
            n, a, b = [], [], []
            for _, ids, _ in encode_texts(texts, classes, merger):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decode_ids(ids, merger)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
