"""Results against plain versions of their definitions, and the cases that are easy to get wrong."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbflow.llm import common, forest, jaccard, mixing, neardup, pii, spans, suffixes, toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, null ids, equal rows, one id with two texts, a long text.
ODD = [(1, None, "en", "s1", 0), (2, "", "en", "s1", 0), (3, "one word", None, None, 8), (3, "one word", None, None, 8), (3, "another text", "de", "s2", 12), (None, "a b c d e f", "de", "s2", 11), (None, None, None, None, None), (5, "long " * 60_000, "fr", "s3", 300_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KIND)


@pytest.fixture(scope="module")
def clash(odd):
    """The same rows with a column for every name that an operator uses inside."""
    names = ["p_toxic", "is_toxic", "p_low_quality", "is_low_quality", "__p", "__key", "__digest", "__cuts", "__copies", "__again", "__extra", "key", "row", "id", "digest", "part", "place", "copies", "again", "domain", "cuts", "label", "m", "k"]
    return odd.withColumns({c: F.lit(f"own {c}") for c in names})


def rows_of(df):
    return sorted(map(repr, df.collect()))


# --- op 2 --------------------------------------------------------------------------------------------------------
def pii_brute(text):
    """The base spans as the definition gives them, by regular expressions alone."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd, even = d[-1::-2], [2 * x - 9 * (x > 4) for x in d[-2::-2]]
        if 16 <= len(d) <= 19 and (sum(odd) + sum(even)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_spans_match_the_patterns():
    rng = random.Random(21)
    parts = ["a@b.co", "@", ".", "+", "-", " ", "1", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "x", "%", "é", "(", ")", "0", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == pii_brute(t), t


def test_pii_terms_match_counting(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    people = {f"p{i}@mail.org": rng.sample(vocabulary, 2) for i in range(6)}
    rows = []
    for i in range(240):
        words = rng.choices(vocabulary[:40], k=12)
        if i % 3 == 0:
            who = rng.choice(list(people))
            words = words + people[who] + [who]
            rng.shuffle(words)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held, n_t, seen = defaultdict(set), defaultdict(int), defaultdict(set)
    for i, t in rows:
        base = pii_brute(t)
        plain = t
        for _, a, b in base:
            plain = plain[:a] + " " * (b - a) + plain[b:]
        for w in set(re.findall(r"\w+", t.lower())):
            n_t[w] += 1
        for _, a, b in base:
            held[t[a:b]].add(i)
            for w in set(re.findall(r"\w+", plain.lower())):
                seen[t[a:b], w].add(i)
    want = set()
    for (e, w), own in seen.items():
        n_e = len(held[e])
        if n_e >= 3 and len(own) >= 3:
            pmi = np.log(min(1.0, len(own) / n_t[w]) * len(rows) / n_e)
            if pmi / np.log(len(rows) / n_e) >= 0.8:
                want.add(w)
    got = {rows[r.doc_id][1][int(a) : int(b)] for r in pii.digest(pii.scan(docs)).collect() for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "term"}
    assert got == want and want


# --- op 3 --------------------------------------------------------------------------------------------------------
def chain_brute(model, text):
    """The chain's probabilities for one text, a link and a word at a time."""
    words = re.findall(r"[^\W\d_]+", text)
    shape, present, row = toxicity.form(text, words), toxicity.traits(words), []
    for k in model.links:
        x = [(s - m) / d for s, m, d in zip(shape, k.mean, k.spread, strict=True)] + row + [1.0]
        z = sum(a * w for a, w in zip(x, k.weights, strict=False)) + sum(k.weights[len(x) + i] for w, i in k.words.items() if w in present)
        row.append(1 / (1 + np.exp(-z)))
    return row


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=20) + (["vile" + words[i % 9]] if i % 5 == 0 else [])), int(i % 5 == 0), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int, q int")
    labels = docs.select("doc_id", F.col("q").alias("quality"), F.col("y").alias("toxic"))
    return docs.select("doc_id", "text"), labels, toxicity.train(docs, labels, toxicity.LABELS)


def test_chain_matches_plain_scoring(spark, toxic):
    docs, _, model = toxic
    for r in toxicity.score(docs.where("doc_id < 40"), model).collect():
        assert np.allclose([r.p_low_quality, r.p_toxic], chain_brute(model, r.text), atol=1e-9)


def test_toxicity_sample_is_bounded_where_ids_repeat(spark, toxic):
    docs, labels, _ = toxic
    many = docs.where("doc_id = 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("again").union(docs.where("doc_id = 1"))
    model = toxicity.train(many, labels.where("doc_id < 2"), toxicity.LABELS, sample_rows=2)
    assert len(model.links) == 2


def test_toxicity_columns_that_clash(clash, toxic):
    out = toxicity.score(clash, toxic[2])
    assert dict(out.dtypes)["is_toxic"] == "boolean" and dict(out.dtypes)["__p"] == "string" and out.count() == len(ODD)
    kept = clash.where(~toxicity.rejected(toxic[2], "toxic"))
    assert kept.columns == clash.columns and {r.is_toxic for r in kept.collect()} == {"own is_toxic"}


# --- op 4 --------------------------------------------------------------------------------------------------------
def test_sentence_spans_match_a_dictionary(spark, odd, clash):
    rng = random.Random(3)
    lines = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 40))) + rng.choice(["." , "!", "?\n", "\n", " "]) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(7, "Another text of id seven. It is short. It has three.")]
    memory = common.WordHashes()
    cut = []
    for d, t in rows:
        starts, ends, _ = spans.sentences(t, memory)
        cut.append((d, t, [t[a:b].lower().split() for a, b in zip(starts, ends, strict=True)], starts, ends))
    first = {}
    for d, _, own, _, _ in cut:
        for i in range(len(own) - 2):
            k = repr(own[i : i + 3])
            first[k] = min(first.get(k, d), d)
    want = []
    for d, _, own, starts, ends in cut:
        gone, met = set(), set()
        for i in range(len(own) - 2):
            k = repr(own[i : i + 3])
            if first[k] < d or k in met:
                gone |= {i, i + 1, i + 2}
            met.add(k)
        want.append((d, len(own), len(gone), ",".join(f"{starts[i]}:{ends[i]}" for i in sorted(gone))))
    got = [tuple(r) for r in spans.removed_spans(spans.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))).collect()]
    assert sorted(got) == sorted(want)
    out = spans.remove(clash)
    assert out.columns == clash.columns and rows_of(out.select(*odd.columns).where("doc_id < 5")) == rows_of(odd.where("doc_id < 5"))


def test_sentences_of_a_long_run_of_marks_take_linear_time():
    import time

    memory, took = common.WordHashes(), []
    for n in (50_000, 400_000):
        began = time.time()
        assert len(spans.sentences("." * n + "x", memory)[0]) == 1
        took.append(time.time() - began)
    assert took[1] < 5


def test_any_fifty_words_in_a_row_share_a_run():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    memory = common.WordHashes()
    for _ in range(300):
        passage = rng.choices(words, k=50)
        seen = []
        for _ in range(2):
            t = " ".join(rng.choices(words, k=rng.randint(0, 40)) + passage + rng.choices(words, k=rng.randint(0, 40)))
            h = spans.run_hashes(spans.sentences(t, memory)[2], 3)[0]
            seen.append(set(h.tolist()))
        assert seen[0] & seen[1]


# --- op 5 --------------------------------------------------------------------------------------------------------
def test_equal_vectors_tie_to_the_smaller_id(spark):
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((2, 64))
    rows = [(i, v.tolist()) for i in range(13)] + [(50, (v + 0.4 * q).tolist()), *[(100 + i, x.tolist()) for i, x in enumerate(rng.standard_normal((200, 64)))]] + [(None, v.tolist()), (60, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id, r.score) for r in forest.search(df, df.where("vec_id = 50")).collect())
    assert [g[1] for g in got] == [0, 1, 2, 3, 4] and len({g[2] for g in got}) == 1
    again = forest.search(df, df.where("vec_id = 3")).orderBy("rank").collect()
    assert [r.vec_id for r in again] == [0, 1, 2, 4, 5]


def test_forest_descends_to_the_longest_prefix():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = forest.Forest(x, 4, 30)
    codes = [f.codes(x, p) for p in f.planes]
    for i, near in f.candidates(x[:20], 40):
        common_ = np.max([[30 - int(a ^ c[i]).bit_length() for a in c] for c in codes], axis=0)
        depth = max(d for d in range(31) if (common_ >= d).sum() >= 40)
        assert set(near) == set(np.flatnonzero(common_ >= depth))


# --- op 1 --------------------------------------------------------------------------------------------------------
def test_near_duplicates_of_a_planted_table(spark):
    """Chains longer than a list, hubs with far ends, a component over several blocks, equal vectors and single ones."""
    rng = np.random.default_rng(12)

    def step(v, angle):
        w = rng.standard_normal(v.shape)
        w -= (w @ v) * v
        return np.cos(angle) * v + np.sin(angle) * w / np.linalg.norm(w)

    def ray():
        v = rng.standard_normal(48)
        return v / np.linalg.norm(v)

    x = []
    for _ in range(3):  # chains: only neighbours are linked
        v = ray()
        for _ in range(25):
            x.append(v)
            v = step(v, 0.40)
    for _ in range(3):  # hubs: all are linked with the centre, few with each other
        c = ray()
        x += [c] + [step(c, 0.42) for _ in range(30)]
    c = ray()
    x += [step(c, 0.2) for _ in range(120)]
    x += [x[0]] * 4 + [ray() for _ in range(150)]
    x = np.array(x)[rng.permutation(len(x))]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    label = np.arange(len(x))
    while (new := np.where(hit, label, len(x)).min(1)).tolist() != label.tolist():
        label = new
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df, block=40).collect()}
    assert got == {i: (int(hit[i].sum()) - 1, int(label[i]), int(label[i]) == i) for i in range(len(x))}


def test_near_duplicates_raise_below_the_recall(spark, monkeypatch):
    monkeypatch.setattr(neardup, "audit", lambda nodes, *a: (0.5, nodes.sparkSession.createDataFrame([], "a long, b long")))
    df = spark.createDataFrame([(i, [1.0 + i, 2.0, 3.0 * i]) for i in range(6)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        neardup.near_duplicates(df, attempts=2)


# --- op 6 --------------------------------------------------------------------------------------------------------
def test_anchors_do_not_depend_on_the_stretch():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    ends = np.array([40, 40, 1300, 1349, 4000, 5000])
    whole = suffixes.anchors(data, ends)
    for most in (64, 777):
        at, h = suffixes.anchors(data, ends, most)
        assert at.tolist() == whole[0].tolist() and h.tolist() == whole[1].tolist()


def test_a_text_above_16_mib(spark):
    rng = np.random.default_rng(7)
    passage = "".join(chr(c) for c in rng.integers(97, 123, 400))
    filler = bytes(rng.integers(97, 123, 17_500_000).astype(np.uint8)).decode()
    df = spark.createDataFrame([(1, passage), (2, filler + passage + "end")], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(suffixes.dedup(df)).collect()}
    assert got[2] == (len(filler) + 403, 400, 1, hashlib.sha256((filler + "end").encode()).hexdigest()) and got[1][1] == 0


# --- op 8 --------------------------------------------------------------------------------------------------------
def spent(plan):
    return plan.agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0]


def test_mixing_spends_all_where_a_weight_is_zero(spark):
    rows = [(i, "w " * 10, ["en", "de"][i % 2], "src0" if i < 60 else "src5", 20) for i in range(120)]
    docs = spark.createDataFrame(rows, KIND)
    weights = {"domain": {"web": 2.0, "books": 1.0}, "lang": {"en": 0.0}}
    plan = mixing.plan(docs, fraction=0.5, weights=weights, max_epochs=1)
    assert spent(plan) == 600 and plan.where("lang = 'en' and copies > 0").count() == 0


def test_mix_takes_what_the_plan_says_of_equal_rows(spark, clash):
    rows = [(1, "w " * 10, "en", "src0", 20)] * 40 + [(i, "w " * 10, "en", "src0", 20) for i in range(2, 12)]
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    for fraction in (0.1, 0.5, 0.9):
        plan = mixing.plan(docs, fraction=fraction, weights={}, max_epochs=2)
        assert spent(plan) == int(500 * fraction)
        assert mixing.mix(docs, fraction=fraction, weights={}, max_epochs=2).count() == plan.agg(F.sum("copies")).first()[0]
    out = mixing.mix(clash, fraction=1.0, weights={}, max_epochs=1)
    # a leaf without tokens has no budget; all others are taken once
    own = clash.where("lang is null or lang <> 'en'").where("text is not null")
    assert out.columns == clash.columns and rows_of(out.where("text is not null")) == rows_of(own)


# --- op 10 and the pipeline --------------------------------------------------------------------------------------
def test_one_row_of_each_class_stays(spark, clash):
    out = jaccard.keep_one(clash)
    assert out.columns == clash.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect() if len(r.text or "") < 99) == [(False, 1, ""), (False, 2, ""), (False, 3, "another text"), (False, 3, "one word"), (True, 0, ""), (True, 0, "a b c d e f")]


def test_join_fails_below_the_recall(spark):
    docs = spark.createDataFrame([(i, f"some words that stand in text {i // 2} alone and here") for i in range(8)], "doc_id long, text string")
    with pytest.raises(RuntimeError, match="op10"):
        jaccard.join(docs, batches=1)


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as p

    sf = str(tmp_path)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    extra = odd.withColumns({c: F.lit("own") for c in ("is_toxic", "__key", "digest", "row", "copies")})
    for docs, many in ((extra, True), (extra.limit(0), False)):
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            docs = common.store(out, "odd")
            assert all(r.digest == "own" for r in docs.collect())
        assert (many or docs.count() == 0) and p.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_no_scratch_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch_dir(Session())
