"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns with clashing names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbflow.llm import bpe, cells, common, forest, jaccard, licenses, mixing, neardup, pii, spans, suffixes, toxicity
from ebbflow.llm.queries import vocabulary

EDGE = [(1, None, "en", "s1", 0), (2, "", "en", "s1", 0), (3, "word", None, None, 4), (3, "word", None, None, 4), (None, "a b c d e f", "de", "s2", 11), (5, "lonely " * 4000, "de", "s2", 28000)]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def edge(spark):
    extra = ["key", "row", "digest", "spans", "tid", "place", "part", "member", "words"]
    return spark.createDataFrame(EDGE, KIND).withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def test_bpe_matches_the_library(spark, edge, none):
    import public_tokenizers as P
    import tiktoken

    data = open(vocabulary(), "rb").read()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(data), special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab 'strevmld\n\té漢1２!?.'　x_😀\x1c\x85") for _ in range(rng.randint(0, 50))) for _ in range(500)] + ["a" * 5000, "x" + " " * 300, "'" * 99 + "s"]
    classes, merger = bpe.coder(data)
    for t, (raw, ids, _) in zip(texts, bpe.encode_texts(texts, classes, merger), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert bpe.decode_ids(ids, merger) == raw == t.encode()
    got = {(r.doc_id, r.n_tokens) for r in bpe.round_trip(edge, vocabulary()).collect()}
    assert (1, 0) in got and (2, 0) in got and len(bpe.round_trip(edge, vocabulary()).collect()) == len(EDGE)
    back = bpe.decode(bpe.encode(edge, vocabulary()), vocabulary()).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, *_ in EDGE)
    assert bpe.round_trip(none, vocabulary()).count() == 0


def test_pii_base_spans():
    text = "mail a.b@x.co.uk, +1 (499) 555-6503 card 4111 1111 1111 1111 at 1.2.3.4 not 300.1.1.1"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "a.b@x.co.uk"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (499) 555-6503")]
    assert pii.base_spans("@" * 1000 + "1" * 50_000) == []


def test_pii_terms_that_reveal_go(spark, edge, none):
    rows = [(i, f"note {i} from zorblax agent{i % 2} bob@x.org about {i * 7} things") for i in range(6)] + [(100 + i, f"plain text {i} from agent{i % 2} about things") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("zorblax" not in out[i] and "bob@" not in out[i] and "[EMAIL]" in out[i] and "about" in out[i] for i in range(6))
    assert all(out[100 + i] == t for i, (_, t) in enumerate(rows[6:]))
    d = {r.doc_id: r for r in pii.digest(pii.scan(docs)).collect()}
    assert d[0].n_email == 1 and "term:" in d[0].spans and d[0].base_sha256 == hashlib.sha256(d[0].spans.split(",")[0].encode()).hexdigest()
    assert pii.scan(edge).count() == len(EDGE) and pii.scan(none).count() == 0
    assert pii.sanitise(edge).columns == edge.columns and pii.sanitise(edge).count() == len(EDGE)


def test_pii_terms_go_wherever_they_stand(spark):
    far = " ".join(f"filler{i}" for i in range(20))
    rows = [(i, f"case {i} of bob@x.org {i * 7} {far} zorblax then zorblax again") for i in range(6)] + [(50, "zorblax without the value")] + [(100 + i, f"plain text {i} {far}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any("zorblax" in t for t in out.values()) and all(out[d] == t for d, t in rows[7:])
    n = {r.doc_id: r.n_term for r in pii.digest(pii.scan(docs)).collect()}
    assert n[50] == 1 and n[0] >= 2 and n[100] == 0


def test_toxicity_held_out_accuracy(spark, edge, none):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(600):
        w = rng.choices(words, k=30)
        if i % 5 == 0:
            w[rng.randrange(30)] = "vile" + rng.choice(words)
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = docs.where("doc_id < 400").select("doc_id", F.lit(1).alias("quality"), F.col("y").alias("toxic"))
    model = toxicity.train(docs, labels, toxicity.LABELS)
    got = toxicity.score(docs.where("doc_id >= 400"), model).agg(F.avg((F.col("is_toxic") == (F.col("y") == 1)).cast("double"))).first()[0]
    assert got > 0.97
    assert toxicity.score(edge, model).count() == len(EDGE) and toxicity.score(none, model).count() == 0
    untrained = toxicity.train(none, labels.limit(0), toxicity.LABELS)
    assert toxicity.score(edge, untrained).where("is_toxic").count() == 0


def test_sentence_spans(spark, edge, none):
    p = "The first one stands here. A second follows it. The third is last. And a fourth."
    docs = spark.createDataFrame([(1, "Own start here. " + p), (2, "Other words. " + p + " Own end."), (3, "Nothing shared at all. Indeed nothing. Not one word.")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in spans.remove(docs).collect()}
    assert out[1].endswith(p) and "second follows" not in out[2] and "Other words." in out[2] and "Own end." in out[2] and out[3].startswith("Nothing")
    assert spans.find(edge).count() == len(EDGE) and spans.remove(edge).count() == len(EDGE) and spans.find(none).count() == 0


def brute(rows):
    first = {}
    for d, t in rows:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(d, first.get(t[i : i + 50], d))
    out = {}
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        out[d] = (len(t), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_suffix_array_matches_brute_force(spark, edge, none, crowd):
    rng = random.Random(crowd)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(30, 300))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(base)[rng.randrange(20) :] for _ in range(rng.randint(0, 3)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.digest(suffixes.dedup(docs, crowd=crowd)).collect()}
    assert got == brute([(d, t.encode()) for d, t in rows])
    assert suffixes.dedup(edge).count() == len(EDGE) and suffixes.dedup(none).count() == 0


def test_loser_tree_merges_and_keeps_prefixes():
    rng = np.random.default_rng(3)
    runs, every = [], []
    for k in range(5):
        m = rng.integers(0, 2, (40, suffixes.KEY)).astype(np.uint8)
        keys = sorted(x.tobytes() for x in m)
        every += keys
        a = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, suffixes.KEY)
        col = np.full(len(a), k)
        runs.append(suffixes.Run([suffixes.front_code(a[:25], col[:25], col[:25], col[:25]), suffixes.front_code(a[25:], col[25:], col[25:], col[25:])]))
    got = list(suffixes.merge(runs))
    assert [g[0] for g in got] == sorted(every)
    assert all(h == suffixes.common_prefix(x[0], y[0], 0) for x, y, h in zip(got, got[1:], [g[1] for g in got[1:]], strict=False))


def test_licenses(spark, edge, none):
    docs = spark.createDataFrame([(1, "x y z\nReleased under the MIT License."), (2, "All rights reserved"), (3, licenses.TEMPLATES["mit-grant"].replace("restriction", "limits")), (4, "released under no license at all")], "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert {(1, "mit-line"), (2, "all-rights-reserved"), (3, "mit-grant")} == got
    assert licenses.scan(edge).count() == 0 and licenses.scan(none).count() == 0


def test_mixing_spends_the_budget_and_lends_to_siblings_first(spark, edge, none):
    rows = [(i, "w " * 10, lang, f"src{i % 3}", 20) for i, lang in enumerate(["en"] * 60 + ["de"] * 30)]
    docs = spark.createDataFrame(rows, KIND)
    got = mixing.plan(docs, fraction=0.5, weights={}, max_epochs=1, domain="'all'").groupBy("lang").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n")).collect()
    n = {r.lang: r.n for r in got}
    assert 400 <= sum(n.values()) <= 450 and abs(n["en"] - n["de"]) <= 30
    tight = spark.createDataFrame([(i, "w " * 10, "en" if i < 5 else "de", "src0", 20) for i in range(60)], KIND)
    n = {r.lang: r.n for r in mixing.plan(tight, fraction=0.5, weights={}, max_epochs=2, domain="'all'").groupBy("lang").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n")).collect()}
    assert n["en"] == 100 and 180 <= n["de"] <= 200
    assert mixing.mix(edge).columns == edge.columns and mixing.plan(edge).count() == len(EDGE) and mixing.plan(none).count() == 0


def test_jaccard_matches_brute_force(spark, edge, none):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(30):
        t = rng.choices(words, k=120)
        rows.append(t)
        for _ in range(rng.randint(0, 4)):
            u = list(t)
            for _ in range(rng.randint(0, 5)):
                u[rng.randrange(len(u))] = rng.choice(words)
            rows.append(u)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    sets = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in rows]
    n = [sum(i != j and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert {r.doc_id: r.n_links for r in jaccard.join(docs, block=8).collect()} == dict(enumerate(n))
    got = {(r.doc_id, r.n_links) for r in jaccard.join(edge).collect()}
    assert {(1, 0), (2, 0), (3, 1), (None, 0), (5, 0)} == got
    assert jaccard.keep_one(edge).count() == len(EDGE) - 1 and jaccard.join(none).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    x = np.concatenate([c + 0.12 * rng.standard_normal((rng.integers(1, 12), 16)) for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] + [1.0] * 15), (1005, [None] + [1.0] * 15), (1006, rows[0][1])]
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("key", F.lit("clash")), x


def test_near_duplicates_match_brute_force(spark, vectors):
    df, x = vectors
    u = np.concatenate([x, x[:1]])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r for r in neardup.near_duplicates(df, block=8).collect()}
    assert [got[i].n_links for i in range(len(x))] == links[:-1].tolist() and got[1006].component_id == 0 and not got[1006].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1006))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def neardup_brute(x, threshold=0.9):
    """(links, component) of each row by all pairs."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= threshold
    label = np.arange(len(x))
    while (new := np.where(hit, label, len(x)).min(1)).tolist() != label.tolist():
        label = new
    return (hit.sum(1) - 1).tolist(), label.tolist()


def test_near_duplicates_keep_links_that_saturated_lists_cut(spark):
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]

    def tight(centre, n):
        return centre + 0.004 * rng.standard_normal((n, 64))

    def tilted(a, b, cos):
        return cos * a + np.sqrt(1 - cos * cos) * b

    # a later row beside a tight group, two tight groups that are linked to each other, and one that is linked to none
    x = np.concatenate([tight(axes[0], 100), tilted(axes[0], axes[1], 0.92)[None], tight(axes[2], 70), tight(tilted(axes[2], axes[3], 0.905), 70), tight(axes[4], 60)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(df, block=32, audited=1, attempts=1).collect()}
    assert [got[i] for i in range(len(x))] == list(zip(*neardup_brute(x), strict=True))


def test_near_duplicates_find_isolated_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(6)
    one, other = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 500, 64)))
    other -= (one * other).sum(1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    group = rng.standard_normal(64) + 0.02 * rng.standard_normal((700, 64))
    x = np.concatenate([group, one, 0.905 * one + np.sqrt(1 - 0.905**2) * other, rng.standard_normal((1000, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in neardup.near_duplicates(df, trees=4, window=8, rounds=1).collect()}
    assert sum(got[700 + i] == got[1200 + i] for i in range(500)) >= 0.98 * 500 and {got[i] for i in range(700)} == {0}


def test_forest_recall_and_edges(spark, vectors):
    df, x = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in forest.search(df, df.where("vec_id % 10 = 0"), shard_rows=150, power=0.7).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert 1002 not in got and 1000 not in got
    hit = n = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -2
        want = np.sort(s)[-5:]
        hit += sum(v[1] >= want[0] - 1e-9 for v in found.values())
        n += 5
        assert sorted(found) == [1, 2, 3, 4, 5]
    assert hit >= 0.9 * n
    assert forest.search(df.limit(0), df).count() == 0


def test_components_and_bridges(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40) if i != 20] + [(50, 50), (60, 61)], "a long, b long")
    got = {r.id: r.component for r in common.components(e).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, **{i: 21 for i in range(21, 41)}, 60: 60, 61: 60}
    m = np.ones((6, 6), bool)
    assert len(cells.bridges(m, 3)) == 1 and len(cells.forest(m)) == 5


def test_pipeline_keeps_columns_and_clean_documents(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = common.store(out, "t")
    assert docs.count() > 0.4 * spark.read.parquet(f"{sf}/documents.parquet").count()
    assert p.STAGES[-1][1](spark, docs, sf).count() == docs.count()
