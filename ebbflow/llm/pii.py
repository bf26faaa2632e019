"""Personal data: base patterns, and terms that reveal a protected value by corpus co-occurrence.

Base spans are e-mail addresses, IP addresses, card and phone numbers. On top, each distinct value is a protected
entity e. Over the whole corpus, the terms t in the documents that mention it are counted, and the pointwise mutual
information pmi(e, t) = ln(n(e,t) N / (n(e) n(t))) is held against the information content of the entity,
ic(e) = ln(N / n(e)). A term with pmi / ic at or above ``generalise_at`` discloses the entity: every occurrence of it
in any text is generalised to its shape, or removed from ``remove_at`` up. N and all n count different whole texts, so
copies of one text are neither evidence for a term nor against it, and no text that differs is left out, whatever words
stand around the value. At least ``support`` texts are asked for n(e) and n(e,t); with 1 every value and pair is judged.

Defined results: a null text is empty; repeated rows each give a row with the same spans; other columns pass through
``sanitise`` untouched; an empty table gives an empty one; every scan is linear in the text, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_rows, store

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The character classes and patterns of the four kinds.
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with a domain behind it takes the run of local characters before it, as far as the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        end = at + 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            yield a, (end := m.end())
        done = end
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost and non-overlapping within a kind."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def words(text: str, spans: list[tuple[str, int, int]]) -> list[re.Match]:
    """The words of a text that no span touches."""
    taken = sorted((a, b) for _, a, b in spans)
    out, i, end = [], 0, 0
    for m in _WORD.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            end = max(end, taken[i][1])
            i += 1
        if m.start() >= end:
            out.append(m)
    return out


def values(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The entities that the spans of a text name, each once."""
    return sorted({f"{kind}:" + re.sub(r"[^0-9A-Za-z@.]", "", text[a:b]).lower() for kind, a, b in spans})


def term_hashes(terms, memory: WordHashes) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, terms), np.uint64).view(np.int64)


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, text): 64 bits that are equal for equal texts; null is empty."""
    return docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text"))


def mentions(docs: DataFrame) -> DataFrame:
    """(row, entities, terms) of each different text that has any span, written to the shared folder."""

    def run(batches):
        import pyarrow as pa

        memory = WordHashes()
        schema = pa.schema([("digest", pa.int64()), ("entities", pa.list_(pa.string())), ("terms", pa.list_(pa.int64()))])
        for digests, texts in arrow_rows(batches, "text", "digest"):
            rows = {"digest": [], "entities": [], "terms": []}
            for digest, t in zip(digests, texts, strict=True):
                if spans := base_spans(t):
                    rows["digest"].append(digest)
                    rows["entities"].append(values(t, spans))
                    rows["terms"].append(term_hashes({m[0].lower() for m in words(t, spans)}, memory))
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    out = docs.mapInArrow(run, "digest long, entities array<string>, terms array<long>").dropDuplicates(["digest"])
    return store(out.select("entities", "terms").withColumn("row", F.monotonically_increasing_id()), "pii-mentions")


def term_counts(docs: DataFrame, repeated) -> DataFrame:
    """(term as 64-bit hash, n): in how many different texts each word stands, added up in each task before the shuffle.
    Texts whose digest is in ``repeated``, a sorted broadcast, are kept apart until their copies have met."""

    def run(batches):
        import pyarrow as pa

        n, memory, done, again = Counter(), WordHashes(), set(), repeated.value

        def out(digest, terms, many):
            return pa.RecordBatch.from_arrays([pa.array([digest] * len(many), pa.int64()), pa.array(terms), pa.array(many, pa.int64())], ["digest", "term", "n"])

        for digests, texts in arrow_rows(batches, "text", "digest"):
            at = np.minimum(np.searchsorted(again, digests), len(again) - 1)
            copied = again[at] == digests if len(again) else np.zeros(len(digests), bool)
            for digest, t, copy in zip(digests, texts, copied.tolist(), strict=True):
                own = set(_WORD.findall(t.lower()))
                if not copy:
                    n.update(own)
                elif digest not in done:
                    done.add(digest)
                    yield out(digest, term_hashes(own, memory), [1] * len(own))
            if len(n) > 400_000:
                yield out(None, term_hashes(n, memory), list(n.values()))
                n.clear()
        yield out(None, term_hashes(n, memory), list(n.values()))

    each = docs.mapInArrow(run, "digest long, term long, n long").groupBy("digest", "term").agg(F.sum("n").alias("n"))
    once = F.when(F.col("digest").isNull(), F.col("n")).otherwise(1)
    return each.groupBy("term").agg(F.sum(once).alias("n"))


def pair_counts(held: DataFrame) -> DataFrame:
    """(entity, term, n) over rows (entities, terms), added up in each task before the shuffle."""

    def run(batches):
        import pyarrow as pa

        n: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([e for e, _ in n], pa.string()), pa.array([t for _, t in n], pa.int64()), pa.array(list(n.values()), pa.int64())], ["entity", "term", "n"])

        for b in batches:
            for entities, terms in zip(b.column("entities").to_pylist(), b.column("terms"), strict=True):
                own = terms.values.to_pylist()
                for e in entities:
                    n.update((e, t) for t in own)
                    if len(n) > 200_000:
                        yield out()
                        n.clear()
        yield out()

    return held.mapInArrow(run, "entity string, term long, n long").groupBy("entity", "term").agg(F.sum("n").alias("n"))


def disclosing(found: DataFrame, counts: DataFrame, n_docs: int, generalise_at: float, support: int) -> DataFrame:
    """(term, share): terms whose share of an entity's information is at least ``generalise_at``."""
    units = found.select("row", F.explode("entities").alias("entity"))
    entities = units.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    held = units.join(entities.select("entity"), "entity").groupBy("row").agg(F.collect_list("entity").alias("entities")).join(found.select("row", "terms"), "row")
    pairs = pair_counts(held.select("entities", "terms")).where(F.col("n") >= support).withColumnRenamed("n", "n_et")
    known = pairs.join(entities, "entity").join(counts.withColumnRenamed("n", "n_t"), "term")
    share = 1 + F.ln(F.least(F.lit(1.0), F.col("n_et") / F.col("n_t"))) / F.ln(F.lit(float(max(n_docs, 2))) / F.least(F.col("n_e"), F.lit(max(n_docs, 2) / 2.0)))
    return known.select("term", share.alias("share")).where(F.col("share") >= generalise_at).groupBy("term").agg(F.max("share").alias("share"))


class Marker:
    """Finds every occurrence of the disclosing terms in a text: sorted hashes and shares, sent once to each worker."""

    def __init__(self, docs: DataFrame, generalise_at: float, support: int, text: str):
        texts = hashed(docs, text)
        sizes = texts.groupBy("digest").agg(F.count("*").alias("n"))
        repeated = np.sort(sizes.where("n > 1").select("digest").toArrow().column("digest").to_numpy())
        counts = term_counts(texts, docs.sparkSession.sparkContext.broadcast(repeated))
        terms = disclosing(mentions(texts), counts, sizes.count(), generalise_at, support).toArrow()
        h, share = terms.column("term").to_numpy(), terms.column("share").to_numpy()
        order = np.argsort(h)
        self.terms = docs.sparkSession.sparkContext.broadcast((h[order], share[order]))
        self.memory = None

    def __call__(self, text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, float]]:
        h, share = self.terms.value
        if not len(h):
            return []
        if self.memory is None:
            self.memory = WordHashes()
        some = term_hashes({w.lower() for w in set(_WORD.findall(text))}, self.memory)
        if not (h[np.minimum(np.searchsorted(h, some), len(h) - 1)] == some).any():
            return []
        every = words(text, spans)
        own = term_hashes((m[0].lower() for m in every), self.memory)
        at = np.minimum(np.searchsorted(h, own), len(h) - 1)
        return [(*every[i].span(), float(share[at[i]])) for i in np.flatnonzero(h[at] == own).tolist()]


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", generalise_at: float = 0.8, support: int = 3) -> DataFrame:
    """(key, spans array<kind, a, b>, extra array<a, b, share>) of every row of ``docs``; positions are code points."""
    mark = Marker(docs, generalise_at, support, text)

    def run(batches):
        import pyarrow as pa

        place = [("a", pa.int32()), ("b", pa.int32())]
        schema = pa.schema([(key, pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), *place]))), ("extra", pa.list_(pa.struct([*place, ("share", pa.float64())])))])
        for keys, texts in arrow_rows(batches, text, key):
            spans = [base_spans(t) for t in texts]
            extra = [mark(t, own) for t, own in zip(texts, spans, strict=True)]
            rows = {key: keys, "spans": [[dict(zip("kind a b".split(), s, strict=True)) for s in own] for own in spans], "extra": [[dict(zip("a b share".split(), e, strict=True)) for e in own] for own in extra]}
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    kind = "spans array<struct<kind:string,a:int,b:int>>, extra array<struct<a:int,b:int,share:double>>"
    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"`{key}` long, {kind}")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans) of what ``scan`` returns."""
    base = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.a.cast("string"), s.b.cast("string"))))
    extra = F.concat_ws(",", F.transform(F.coalesce("extra", F.array()), lambda s: F.concat_ws(":", F.lit(TERM), s.a.cast("string"), s.b.cast("string"))))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    n_term = F.coalesce(F.size("extra"), F.lit(0)).cast("long")
    every = F.concat_ws(",", F.when(F.size("spans") > 0, base), F.when(n_term > 0, extra))
    return scanned.select(key, *counts, F.greatest(n_term, F.lit(0)).cast("long").alias("n_term"), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def redact(text: str, spans: list[tuple[str, int, int]], extra: list[tuple[int, int, float]], remove_at: float) -> str:
    """Spans replaced by their kind; disclosing terms by their shape, or nothing from ``remove_at`` up."""
    cuts = [(a, b, f"[{k.upper()}]") for k, a, b in spans]
    for a, b, share in extra:
        shape = "[NUMBER]" if text[a:b].isdigit() else "[CODE]" if any(c.isdigit() for c in text[a:b]) else "[WORD]"
        cuts.append((a, b, "" if share >= remove_at else shape))
    out, done = [], 0
    for a, b, to in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if a >= done:
            out += [text[done:a], to]
            done = b
        elif b > done:  # a span that overlaps the one before: its rest goes too
            done = b
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, text: str = "text", key: str = "doc_id", generalise_at: float = 0.8, remove_at: float = 0.95, support: int = 3) -> DataFrame:
    """``docs`` with the personal data of ``text`` taken out; all other columns as they are.

    Base spans and disclosing terms are found in place, so no text is shuffled."""
    mark = Marker(docs, generalise_at, support, text)

    @F.pandas_udf("string")
    def clean(texts):
        import pandas as pd

        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            spans = base_spans(t)
            extra = mark(t, spans)
            out.append(redact(t, spans, extra, remove_at) if spans or extra else t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, clean(F.col(text))).select(*docs.columns)
