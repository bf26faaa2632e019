"""Substring dedup by sliding sentence spans.

A text is cut into sentences (behind . ! ? before white space, and at line ends); a sentence of more than ``window``
words is cut further behind the words with the smallest hash among their neighbours, so that a passage
is cut alike wherever it stands, and no piece is long. Every run
of ``run`` consecutive sentences is hashed (96 bits) and joined over the whole corpus; the sentences under any run but
its first (smallest doc_id, then place) are removed. A task sends each hash once, for its smallest document, sorted and
packed; the others it holds are settled at once, so a passage in very many documents is gathered nowhere.

Rows of one doc_id count as one document; a null doc_id counts as the largest. Defined results: a null text is empty and
has no sentence; a text of fewer sentences than a run loses nothing; repeated rows lose nothing to each other; other
columns pass through ``remove``; an empty table gives an empty one.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import groups
from .common import _PLACES, WordHashes, arrow_rows, mix, pack, store, unpack

#: The end of a sentence: a run of marks before white space, or a line's end. Looked for where a run begins alone, so
#: that a long run of marks with nothing behind is passed once.
_END = re.compile(r"(?<![.!?])[.!?]++(?=\s)|\n")
_WORD = re.compile(r"\S+")
_LAST = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C17)
_BACK = np.uint64(pow(0x9E3779B97F4A7C17, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def cuts(h: np.ndarray, owner: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """The words behind which long sentences are cut: the smallest hash of every ``window`` words of one sentence (the last
    of equal ones). Two cuts in a row are at most ``window`` apart, and depend on the words around them alone."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    inside = np.flatnonzero((owner[: len(h) - window + 1] == owner[window - 1 :]) & (length[owner[: len(h) - window + 1]] > window))
    near = np.lib.stride_tricks.sliding_window_view(h, window)[inside]
    return np.unique(inside + window - 1 - near[:, ::-1].argmin(1)) if len(inside) else inside


def sentences(text: str, memory: WordHashes, window: int = 12) -> tuple[list[int], list[int], np.ndarray]:
    """(starts, ends, hashes) of the sentences of a text; white space around and letter case do not count. Those of more
    than ``window`` words are cut: any 4 ``window`` words in a row within one hold three whole pieces. Linear in the text."""
    words = text.lower().split()
    if not words:
        return [], [], np.zeros(0, np.uint64)
    at = np.fromiter((m.start() for m in _WORD.finditer(text)), np.int64, len(words))
    h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    marks = [m.span() for m in _END.finditer(text)]
    stop = np.array([a if text[a] == "\n" else b for a, b in marks] + [len(text)], np.int64)  # of each sentence
    start = np.array([0] + [b for _, b in marks], np.int64)
    last = np.searchsorted(at, stop)  # words before its end
    some = np.diff(last, prepend=0) > 0
    start, stop, last = start[some], stop[some], last[some]
    length = np.diff(last, prepend=0)
    inner = cuts(h, np.repeat(np.arange(len(last)), length), length, window) + 1
    inner = np.setdiff1d(inner, last, assume_unique=True)
    if len(inner):
        # starts and ends by word: those of sentences, and the first letter of the word behind a cut
        begin, end = at.copy(), np.append(at, len(text))
        begin[last - length], end[last] = start, stop
        last = np.sort(np.concatenate([last, inner]))
        length = np.diff(last, prepend=0)
        start, stop = begin[last - length], end[last]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(_BACK, len(h)))])
    own = (sums[last] - sums[last - length]) * powers(_BASE, len(h) + 1)[last]
    return start.tolist(), stop.tolist(), mix(own + length.astype(np.uint64))


def run_hashes(h: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit hash of each run of ``run`` sentences."""
    n = len(h) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    x, y = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(run):
        x += h[i : i + n] * _PLACES[i]
        y += h[i : i + n] * _PLACES[i + 8]
    return mix(x).view(np.int64), (mix(y) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def find(docs: DataFrame, run: int = 3, text: str = "text", key: str = "doc_id", part_bytes: int = 4_000_000) -> DataFrame:
    """(key, digest, starts, ends, removed) of every row: the sentences of its text, and the places of those that go.
    Positions are code points. Hashes meet in as many parts as there are ``part_bytes`` of text; a task holds one part at
    a time."""
    many = docs.agg(F.sum(F.octet_length(text))).first()[0] or 1
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(many) // part_bytes))

    def scan(batches):
        import hashlib

        import pyarrow as pa

        ints = pa.list_(pa.int32())
        kinds = [("part", pa.int32()), ("block", pa.binary()), ("key", pa.int64()), ("tag", pa.int64()), ("digest", pa.string()), ("starts", ints), ("ends", ints), ("gone", ints)]
        memory, held, n = WordHashes(), [], 0

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds], [k for k, _ in kinds])

        def flush():
            h, g, k, tag, at = (np.concatenate([x[i] for x in held]) for i in range(5))
            held.clear()
            order = np.lexsort((k, g, h))
            h, g, k, tag, at = h[order], g[order], k[order], tag[order], at[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            later = k > k[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            rows = []
            o = np.flatnonzero(later)
            o = o[np.lexsort((tag[o], k[o]))]
            cut = np.flatnonzero(np.concatenate([[True], (k[o][1:] != k[o][:-1]) | (tag[o][1:] != tag[o][:-1])])).tolist() if len(o) else []
            for s, e in zip(cut, [*cut[1:], len(o)], strict=False):
                rows.append({"key": k[o[s]], "tag": tag[o[s]], "gone": at[o[s:e]]})
            h, g, k, tag, at = (x[~later] for x in (h, g, k, tag, at))
            part = (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64)).tolist()
            for p, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                if s < e:
                    rows.append({"part": p, "block": pack(*(x[s:e].astype(np.uint64) for x in (h, g, k, tag, at)))})
            return batch(rows)

        for keys, texts in arrow_rows(batches, text, key):
            rows = []
            for k, t in zip(keys, texts, strict=True):
                k, digest = _LAST if k is None else k, hashlib.md5(t.encode()).hexdigest()
                tag = int(digest[:8], 16)
                starts, ends, own = sentences(t, memory)
                h, g = run_hashes(own, run)
                at = np.unique(h, return_index=True)[1]  # runs met before in the same document go in any case
                inner = np.setdiff1d(np.arange(len(h)), at)
                rows.append({"key": k, "tag": tag, "digest": digest, "starts": starts, "ends": ends, "gone": inner})
                held.append((h[at].view(np.uint64), g[at].view(np.uint32), np.full(len(at), k), np.full(len(at), tag), at))
                n += len(at)
            yield batch(rows)
            if n > 1_000_000:
                yield flush()
                n = 0
        if n:
            yield flush()

    out = docs.select(key, text).mapInArrow(scan, "part int, block binary, key long, tag long, digest string, starts array<int>, ends array<int>, gone array<int>")
    sent = store(out, "sentences")

    def meet(batches):
        import pyarrow as pa

        for _, t in groups(batches, ["part"]):
            h, g, k, tag, at = map(np.concatenate, zip(*[unpack(x, 5) for x in t.column("block").to_pylist()], strict=True))
            k = k.astype(np.int64)
            order = np.lexsort((k, g, h))
            h, g, k = h[order], g[order], k[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            later = k > k[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            yield pa.RecordBatch.from_arrays([pa.array(k[later]), pa.array(tag[order][later].astype(np.int64)), pa.array(at[order][later].astype(np.int32))], ["key", "tag", "at"])

    far = sent.where("part is not null").select("part", "block").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(meet, "key long, tag long, at int")
    near = sent.where("part is null and digest is null").select("key", "tag", F.explode("gone").alias("at"))
    across = far.unionByName(near).groupBy("key", "tag").agg(F.collect_set("at").alias("across"))
    joined = sent.where("digest is not null").drop("part", "block").join(across, ["key", "tag"], "left")
    gone = F.array_union("gone", F.coalesce("across", F.array().cast("array<int>")))
    removed = F.array_sort(F.array_distinct(F.flatten(F.transform(gone, lambda i: F.sequence(i, i + F.lit(run - 1))))))
    return joined.select(F.col("key").alias(key), "digest", "starts", "ends", removed.alias("removed"))


def removed_spans(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_sentences, n_removed, removed): the removed sentences as start:end, comma-joined, in order."""
    spans = F.concat_ws(",", F.transform("removed", lambda i: F.concat_ws(":", F.get("starts", i).cast("string"), F.get("ends", i).cast("string"))))
    return found.select(F.nullif(key, F.lit(_LAST)).alias(key), F.size("starts").cast("long").alias("n_sentences"), F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"))


def remove(docs: DataFrame, run: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the sentences that ``find`` removes; all other columns and rows as they are."""
    found = find(docs, run, text, key).where(F.size("removed") > 0).dropDuplicates([key, "digest"])
    cut = F.transform("removed", lambda i: F.struct(F.get("starts", i).alias("a"), F.get("ends", i).alias("b")))
    cut = found.select(F.col(key).alias("id"), "digest", cut.alias("cuts"))
    # the row travels as one value, so that no column of it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    joined = rows.join(cut, ["id", "digest"], "left")
    body, n = F.col("row").getField(text), F.size("cuts")
    # what is left of the text: the pieces between the removed sentences
    pieces = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substring(body, F.coalesce(F.get("cuts", i - 1)["b"], F.lit(0)) + 1, F.coalesce(F.get("cuts", i)["a"], F.length(body)) - F.coalesce(F.get("cuts", i - 1)["b"], F.lit(0))),
    )
    new = F.when(n > 0, F.concat_ws("", pieces)).otherwise(body)
    return joined.select(*[new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
