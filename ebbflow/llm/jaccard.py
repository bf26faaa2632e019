"""N-gram Jaccard join by chosen paths.

Texts are sets of hashed runs of five words. Equal sets are one member with a weight. Each member has a signature of
min-hashes; a path is a sequence of coordinates, drawn alike for all members of a node, and members go on together while
they agree at the coordinates drawn: each level splits a node by the tokens its sets share. Nodes of at most ``block``
members are compared outright, and so are nodes that are alike on the whole (most agree at a further coordinate), no
longer shrink or have reached the last level, in cells of bounded size. Runs with new seeds are repeated, in batches,
until a batch finds at most ``1 - recall`` of its links new; if that takes too many batches, the join fails.
What the signatures propose is then verified on the exact sets, component by component, so each link counts once.

Defined results: a null or blank text has no set and no link; a text of fewer than five words is one run of all its
words; repeated rows are copies and link with one another; a null key gets a row of its own; extra columns are not
looked at; an empty table gives an empty one. Words are lower-case runs of characters other than white space.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import compare, deal
from .common import WordHashes, arrow_rows, components, drop_stored, shingle_hashes, store, words_of

COORDINATES = 64
_A = np.random.default_rng(64).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(65).integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Min-hash of each coordinate, 32 bits."""
    out = np.empty(COORDINATES, np.uint32)
    for i in range(COORDINATES):
        out[i] = ((shingles * _A[i] + _B[i]) >> np.uint64(32)).min()
    return out


def signatures(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(row, key, digest, set, sig) of every row, written to the shared folder; ``set`` is null where there is none."""

    def run(batches):
        import pyarrow as pa

        memory = WordHashes()
        for keys, texts in arrow_rows(batches, text, key):
            sets = [shingle_hashes(words_of(t), memory, width) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array([hashlib.md5(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.array([hashlib.md5(s.tobytes()).hexdigest() if len(s) else None for s in sets], pa.string()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["key", "digest", "set", "sig"],
            )

    out = docs.select(key, text).mapInArrow(run, "key long, digest string, set string, sig binary")
    return store(out.withColumn("row", F.monotonically_increasing_id()), "signatures")


def children(nodes: DataFrame, level: int, rate: float) -> DataFrame:
    """Members of ``nodes`` (path, parent_n, member, sig) at the coordinates drawn for their path, one at least."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            paths, ids, sizes = b.column("path").to_numpy(), b.column("member").to_numpy(), b.column("parent_n").to_numpy()
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(len(ids), COORDINATES)
            x = paths.view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(level)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            drawn = (x % np.uint64(1 << 20)) < np.uint64(int(rate * (1 << 20)))
            drawn[np.arange(len(ids)), x.argmin(1)] = True
            r, c = np.nonzero(drawn)
            y = (paths.view(np.uint64)[r] ^ (c.astype(np.uint64) << np.uint64(40))) * np.uint64(0x9FB21C651E98DF25) + sig[r, c]
            y = (y ^ (y >> np.uint64(35))) * np.uint64(0x9FB21C651E98DF25)
            y ^= y >> np.uint64(28)
            probe = sig[r, (c + COORDINATES // 2) % COORDINATES].view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(y.view(np.int64)), pa.array(sizes[r]), pa.array(ids[r]), pa.array(probe)], ["path", "parent_n", "member", "probe"])

    return nodes.mapInArrow(run, "path long, parent_n long, member long, probe int")


def proposals(members: DataFrame, first_run: int, runs: int, threshold: float, estimate: float, block: int, levels: int) -> DataFrame:
    """(a, b): spanning edges of the pairs whose signatures agree at ``estimate`` of the coordinates or more, found in
    ``runs`` runs."""
    rate = 1 / (threshold * COORDINATES)
    sigs = members.select(F.col("rep").alias("member"), "sig")
    far = 1 << 62
    nodes = sigs.withColumn("path", F.explode(F.array(*[F.lit(r * 7919 + 1).cast("long") for r in range(first_run, first_run + runs)]))).withColumn("parent_n", F.lit(far).cast("long"))
    ready = None
    for level in range(levels):
        kids = store(children(nodes, level, rate), "paths")
        sizes = kids.groupBy("path", "probe").agg(F.count("*").alias("m")).groupBy("path").agg(F.sum("m").alias("n"), F.max("m").alias("alike")).where("n > 1")
        kids = kids.drop("probe").join(sizes, "path")
        done = (F.col("n") <= block) | (F.col("alike") >= 0.6 * F.col("n"))  # small, or alike on the whole
        if level:
            done = done | (F.col("n") > 0.7 * F.col("parent_n"))  # it no longer shrinks
        if level == levels - 1:
            done = F.lit(True)
        own = kids.where(done).select("path", "n", "member")
        ready = own if ready is None else ready.unionByName(own)
        rest = kids.where(~done)
        if level == levels - 1 or rest.isEmpty():
            break
        nodes = rest.select("path", F.col("n").alias("parent_n"), "member").join(sigs, "member")
    least = math.ceil(estimate * COORDINATES)

    def similar(t, left, right):
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        agree = np.zeros((len(left), len(right)), np.int16)
        x, y = np.ascontiguousarray(sig[left].T), np.ascontiguousarray(sig[right].T)
        for a, b in zip(x, y, strict=True):
            agree += a[:, None] == b[None, :]
        return agree >= least

    # a node may be split over several paths of one name: count anew where levels met
    dealt = deal(ready.join(sigs, "member"), "path", "n", "member", block)
    return compare(dealt, "path", "member", None, similar).where("b is not null").select("a", "b")


def verified(docs: DataFrame, members: DataFrame, comps: DataFrame, threshold: float, block: int, text: str, key: str, width: int) -> DataFrame:
    """(a, b, n) as ``cells.compare`` returns it, on the exact sets within each component of the proposals."""
    sizes = comps.groupBy("component").agg(F.count("*").alias("size"))
    wanted = members.join(comps, members.rep == comps.id).join(sizes, "component").select("component", "size", "rep", "weight", F.coalesce("key", F.lit(-1)).alias("__key"), F.col("digest").alias("__digest"))
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("__key"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("__digest"), F.col(text).alias("text"))
    texts = texts.join(wanted, ["__key", "__digest"])

    def run(batches):
        import pyarrow as pa

        memory = WordHashes()
        for b in batches:
            sets = [shingle_hashes(words_of(t), memory, width).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("component", "size", "rep", "weight")] + [pa.array(sets, pa.large_binary())], ["component", "size", "rep", "weight", "set"])

    sets = texts.select("component", "size", "rep", "weight", "text").mapInArrow(run, "component long, size long, rep long, weight long, set binary")

    def similar(t, left, right):
        col = t.column("set")
        own = {int(i): np.frombuffer(col[int(i)].as_py(), np.uint64) for i in np.union1d(left, right)}
        size = {i: len(s) for i, s in own.items()}
        both = sorted(own)
        place = {i: p for p, i in enumerate(both)}
        tokens = np.concatenate([own[i] for i in both])
        who = np.repeat(np.arange(len(both)), [size[i] for i in both])
        kinds, token = np.unique(tokens, return_inverse=True)
        shared = np.zeros((len(both), len(both)))
        step = max(1, 4_000_000 // len(both))
        order = np.argsort(token, kind="stable")
        token, who = token[order], who[order]
        for lo in range(0, len(kinds), step):  # so many tokens at a time
            s, e = np.searchsorted(token, [lo, lo + step])
            there = np.zeros((min(step, len(kinds) - lo), len(both)), np.float32)
            there[token[s:e] - lo, who[s:e]] = 1
            shared += there.T @ there
        l, r = [place[int(i)] for i in left], [place[int(i)] for i in right]
        n = np.array([size[i] for i in both], float)
        inter = shared[np.ix_(l, r)]
        return inter >= threshold * (n[l][:, None] + n[r][None, :] - inter) - 1e-9

    return compare(deal(sets, "component", "size", "rep", block), "component", "rep", "weight", similar)


def join(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999, text: str = "text", key: str = "doc_id", block: int = 256, levels: int = 12, runs: int = 5, batches: int = 12) -> DataFrame:
    """(row, key, digest, component, class_id, n_links) of every row: smallest key reachable over links of Jaccard
    ``threshold`` or more, and how many other rows it links with directly; ``component`` is null where there is no set.
    Raises if ``batches`` batches of ``runs`` runs still find more than ``1 - recall`` of their links new."""
    rows = signatures(docs, text, key, width)
    reps = rows.where("set is not null").groupBy("set").agg(F.min("row").alias("rep"), F.count("*").alias("weight"), F.min("key").alias("least"))
    reps = store(reps, "reps")
    members = store(reps.join(rows.select(F.col("row").alias("rep"), "key", "digest", "sig"), "rep"), "members")
    edges, known, share = None, None, 0.0
    for turn in range(batches):
        new = store(proposals(members, turn * runs, runs, threshold, threshold - 0.2, block, levels), "proposals")
        edges = new if edges is None else edges.unionByName(new)
        comps = components(edges, "proposed")
        if known is not None:  # edges of this batch that join what was apart
            a, b = known.withColumnsRenamed({"id": "a", "component": "ca"}), known.withColumnsRenamed({"id": "b", "component": "cb"})
            n, fresh = new.join(a, "a", "left").join(b, "b", "left").agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), 0).otherwise(1)), F.lit(0))).first()
            share = 1 - fresh / max(n, 1)
            if share >= recall:
                break
        known = comps
    else:
        raise RuntimeError(f"op10: {share:.4f} of the links of batch {batches} were known before, below {recall}")
    links = store(verified(docs, members, comps, threshold, block, text, key, width), "links")
    classes = components(links.where("b is not null").select("a", "b"), "classes")
    counts = links.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    out = reps.join(classes.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = out.groupBy("component").agg(F.min("least").alias("class_id"))
    out = out.join(least, "component").join(counts, "rep", "left").select("set", "component", "class_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    found = rows.select("row", "key", "digest", "set").join(out, "set", "left")
    return found.select("row", F.col("key").alias(key), "digest", "component", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one row of each class: the smallest key (null last), then the smallest digest, then any of equal rows.
    Rows without a set stay, but for equal ones."""
    joined = join(docs, text=text, key=key, **how).select(F.col(key).alias("id"), "digest", "component")
    first = joined.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("x"))
    kept = first.select("x.id", "x.digest").unionByName(joined.where("component is null").select("id", "digest").distinct())
    # the row travels as one value, so that no column of it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    out = rows.alias("m").join(kept.alias("k"), F.expr("m.id <=> k.id and m.digest = k.digest"), "left_semi")
    return out.dropDuplicates(["id", "digest"]).select("row.*")
