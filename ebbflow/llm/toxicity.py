"""Toxicity by a classifier chain: linear models in sequence, each fed the probabilities of those before it.

The labelled documents are a bounded sample (``sample_rows``), from which words are chosen and models fitted; scores and
decisions cover all rows. A model's features are the presence of the words and beginnings of words (four and five
letters, for languages that build words) that tell its label apart best (chi-square) and a few measures of form. While
training, the earlier categories' probabilities come from folds that did not see the document: a fold's model has its
words chosen and its weights fitted without it. While scoring, they come from the models of the whole sample. Each
threshold is the middle of the range with the best F1 on out-of-fold probabilities.

Defined results: a null text is empty and scored as such; repeated rows each get the same scores; labels that are null
or whose document is missing are left out; of documents that share a labelled doc_id, the text with the smallest digest
is learned from; with no labelled rows of both kinds a category has probability 0 and rejects nothing; other columns
pass through ``score``, but one that has an output's name gives way to it (``rejected`` adds no column); an empty table
gives an empty one. Whole texts are scored, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, store

_WORD = re.compile(r"[^\W\d_]+")
_FORM = ("length", "signs", "upper", "digits", "variety", "word_length", "repeats")


def form(text: str, words: list[str]) -> list[float]:
    """Measures of form, each within about 0 to 1."""
    n, lines = max(len(text), 1), text.split("\n")
    letters = sum(map(len, words))
    upper = n - len(text) + sum(1 for w in words if w.isupper() and len(w) > 1) / max(len(words), 1)
    digits = len(re.findall(r"\d", text)) / n
    return [np.log1p(n) / 12, max(0.0, (n - letters) / n), upper, digits, len(set(words)) / max(len(words), 1), letters / max(len(words), 1) / 12, 1 - len(set(lines)) / len(lines)]


def traits(words: list[str]) -> set[str]:
    """The distinct words, in lower case, and with a mark their beginnings."""
    own = set(map(str.lower, words))
    return own.union(["^" + w[:4] for w in own if len(w) > 4], ["^" + w[:5] for w in own if len(w) > 5])


@dataclass
class Link:
    """One model of the chain."""

    label: str
    words: dict[str, int]
    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    threshold: float


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def score(self, texts: Iterable[str]) -> np.ndarray:
        """Probability of each category (column) for each text, all texts at once: a sparse product for each link."""
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*[k.words for k in self.links])))}
        shapes, rows, cols = [], [], []
        for n, t in enumerate(texts):
            words = _WORD.findall(t)
            shapes.append(form(t, words))
            own = vocabulary.keys() & traits(words)
            cols += [vocabulary[w] for w in own]
            rows += [n] * len(own)
        shape, rows, cols = np.array(shapes, float).reshape(len(shapes), len(_FORM)), np.array(rows, np.int64), np.array(cols, np.int64)
        out = np.zeros((len(shape), 0))
        for k in self.links:
            weight = np.zeros(len(vocabulary))
            for w, i in k.words.items():
                weight[vocabulary[w]] = k.weights[len(_FORM) + out.shape[1] + 1 + i]
            dense = np.column_stack([(shape - k.mean) / k.spread, out, np.ones(len(shape))])
            z = (dense * k.weights[: dense.shape[1]]).sum(1) + np.bincount(rows, weights=weight[cols], minlength=len(shape))
            out = np.column_stack([out, 1 / (1 + np.exp(-np.clip(z, -35, 35)))])
        return out


def fit_linear(dense: np.ndarray, rows: np.ndarray, cols: np.ndarray, n_words: int, y: np.ndarray, ridge: float = 0.3, steps: int = 300) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient; words given by the (row, column) of their presence."""
    n, d = dense.shape
    w = np.zeros(d + n_words)
    v, t = w.copy(), 1.0
    degree = np.bincount(rows, minlength=n)
    bound = 0.25 * ((dense**2).sum(1) + degree).max() * n  # of the curvature, for a first step length
    rate = 16.0 / bound
    last = np.inf

    def value(u):
        z = dense @ u[:d] + np.bincount(rows, weights=u[d:][cols], minlength=n)
        return z, np.logaddexp(0, np.where(y, -z, z)).sum() + 0.5 * ridge * (u**2).sum()

    for _ in range(steps):
        z, f = value(v)
        g = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y
        grad = np.concatenate([dense.T @ g, np.bincount(cols, weights=g[rows], minlength=n_words)]) + ridge * v
        while True:  # as long a step as the decrease allows
            new = v - rate * grad
            _, f_new = value(new)
            if f_new <= f - 0.5 * rate * (grad @ grad) or rate < 1e-12:
                break
            rate /= 2
        if abs(last - f_new) < 1e-7 * max(1.0, f_new):
            w = new
            break
        if f_new > last:  # restart the momentum
            t = 1.0
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t, last, rate = new + (t - 1) / u * (new - w), new, u, f_new, rate * 1.3
    return w


def threshold_of(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the range of thresholds with the best F1."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(f1.argmax())
    return float((p[order][i] + (p[order][i + 1] if i + 1 < len(y) else 0.0)) / 2)


def telling_words(tagged: DataFrame, label: str, n_words: int, folds: int, least: int = 5) -> list[list[str]]:
    """The words with the largest chi-square for ``label``, from (words, label, fold) rows: without each fold in turn, and
    at last over all rows."""
    spread = store(
        tagged.select(F.explode("words").alias("word"), F.col(label).alias("y"), "fold").groupBy("word")
        .agg(*[F.count(F.when(F.col("fold") == k, 1)).alias(f"n{k}") for k in range(folds)], *[F.sum(F.when(F.col("fold") == k, F.col("y")).otherwise(0)).alias(f"a{k}") for k in range(folds)]),
        "toxicity-words",
    )
    totals = {r.fold: (r.n, r.a) for r in tagged.groupBy("fold").agg(F.count("*").alias("n"), F.sum(label).alias("a")).collect()}
    out = []
    for left in [*range(folds), None]:
        used = [k for k in range(folds) if k != left]
        total, hot = (sum(totals.get(k, (0, 0))[c] for k in used) for c in (0, 1))
        a, n = (sum((F.col(f"{c}{k}") for k in used), F.lit(0)).cast("double") for c in "an")
        lift = F.pow(a * total - n * hot, 2) * total / F.greatest(n * (total - n) * hot * (total - hot) * F.lit(1.0), F.lit(1.0))
        best = spread.where(n >= least).select("word", lift.alias("lift")).orderBy(F.desc("lift"), "word").limit(n_words)
        out.append(sorted(r.word for r in best.collect()))  # n_words rows at most
    return out


def train(docs: DataFrame, labels: DataFrame, chain: dict[str, str], text: str = "text", key: str = "doc_id", sample_rows: int = 12_000, n_words: int = 400, folds: int = 3) -> Chain:
    """Fit the chain. ``chain``: name of each category, in order, to the SQL expression of its 0/1 label."""
    names = {c: f"y{i}" for i, c in enumerate(chain)}
    ids = labels.select(F.col(key).alias("id"), *[F.expr(e).cast("int").alias(names[c]) for c, e in chain.items()]).dropna()
    ids = ids.groupBy("id").agg(*[F.max(y).alias(y) for y in names.values()]).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    body = F.coalesce(F.col(text), F.lit(""))
    sample = docs.select(F.col(key).alias("id"), body.alias("text")).join(F.broadcast(ids), "id")  # at most sample_rows ids
    sample = sample.groupBy("id", *names.values()).agg(F.min_by("text", F.md5("text")).alias("text"))  # and as many rows

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = part.column("text").to_pylist()
                found = [_WORD.findall(t) for t in texts]
                rows = [pa.array([sorted(traits(w)) for w in found], pa.list_(pa.string())), pa.array([form(t, w) for t, w in zip(texts, found, strict=True)], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *[part.column(y) for y in names.values()], *rows], ["id", *names.values(), "words", "form"])

    kinds = ", ".join(f"{y} int" for y in names.values())
    tagged = sample.mapInArrow(run, f"id {dict(sample.dtypes)['id']}, {kinds}, words array<string>, form array<double>")
    tagged = store(tagged.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(folds)), F.lit(folds)).cast("int")), "toxicity-sample")
    out = Chain()
    earlier: list[np.ndarray] = []
    for name, label in names.items():
        chosen = telling_words(tagged, label, n_words, folds)
        every = sorted(set().union(*chosen))
        kept = tagged.select("id", label, "fold", "form", F.array_intersect("words", F.array(*map(F.lit, every)) if every else F.array().cast("array<string>")).alias("words"))
        rows = kept.orderBy(F.xxhash64("id"), "id").toPandas()  # at most sample_rows rows of (folds + 1) n_words words
        y = rows[label].to_numpy(dtype=float)
        if not len(rows) or y.min() == y.max():
            p = np.zeros(len(rows))
            out.links.append(Link(name, {}, np.concatenate([np.zeros(len(_FORM) + len(earlier)), [-35.0]]), np.zeros(len(_FORM)), np.ones(len(_FORM)), 0.5))
            earlier.append(p)
            continue
        shape = np.stack(rows["form"])
        owner = np.repeat(np.arange(len(rows)), rows["words"].map(len))
        words = np.array([w for own in rows["words"] for w in own], dtype=object)
        fold, p = rows["fold"].to_numpy(), np.zeros(len(y))
        for k, own in enumerate(chosen):
            learn = fold != k if k < folds else np.ones(len(y), bool)
            if y[learn].size == 0 or y[learn].min() == y[learn].max():
                p[~learn] = y[learn].mean() if y[learn].size else 0.0
                continue
            at = {w: i for i, w in enumerate(own)}
            col = np.array([at.get(w, -1) for w in words], dtype=np.int64)
            r, c = owner[col >= 0], col[col >= 0]
            mean, spread = shape[learn].mean(0), shape[learn].std(0) + 1e-9
            dense = np.column_stack([(shape - mean) / spread, *earlier, np.ones(len(y))])
            used, place = learn[r], np.cumsum(learn) - 1
            w = fit_linear(dense[learn], place[r[used]], c[used], len(own), y[learn])
            if k < folds:
                z = dense @ w[: dense.shape[1]] + np.bincount(r, weights=w[dense.shape[1] :][c], minlength=len(y))
                p[~learn] = (1 / (1 + np.exp(-np.clip(z, -35, 35))))[~learn]
            else:
                out.links.append(Link(name, at, w, mean, spread, threshold_of(p, y)))
        earlier.append(p)
    return out


def probabilities(model: Chain, text: str = "text"):
    """The probabilities of all categories, in the chain's order, as an array column."""

    @F.pandas_udf("array<double>")
    def of(texts):
        import pandas as pd

        out = []
        for lo in range(0, len(texts), 512):
            out += list(model.score(t or "" for t in texts.iloc[lo : lo + 512]))
        return pd.Series(out, dtype=object)

    return of(F.col(text))


def score(docs: DataFrame, model: Chain, text: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` and ``is_<category>`` for each category of the chain. No shuffle."""
    made = [f"{kind}_{k.label}" for k in model.links for kind in ("p", "is")]
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in made]).alias("row")
    rows = docs.select(own, probabilities(model, text).alias("p"))
    each = [c for i, k in enumerate(model.links) for c in (F.col("p")[i].alias(f"p_{k.label}"), (F.col("p")[i] >= F.lit(k.threshold)).alias(f"is_{k.label}"))]
    return rows.select("row.*", *each)


def rejected(model: Chain, label: str, text: str = "text"):
    """Whether the chain finds ``label`` in a text, as a column."""
    (i,) = [n for n, k in enumerate(model.links) if k.label == label]
    return probabilities(model, text)[i] >= F.lit(model.links[i].threshold)


#: The chain over the table ``labels``: form first, then toxicity.
LABELS = {"low_quality": "1 - quality", "toxic": "toxic"}
