"""Mixing sources to target weights: hierarchical budgeting over a domain - language - source tree.

The budget of tokens goes down the tree by weight. A child takes no more than its subtree can supply (its tokens times
``max_epochs``); what it leaves goes to its siblings by weight, and only what all siblings leave goes back to the level
above, whose children share it in turn. Each leaf then takes the token-prefix of its documents in a seeded order:
whole epochs first, then the documents of the last epoch whose running token count stays within the rest.

Everything is built of DataFrame operations. The prefix is found without sorting a leaf in one task: the order is the
hex digest md5(seed:epoch:doc_id:digest of the text), token sums per leading hex digits give the bucket in which the
budget ends, level by level, and only that bucket is put in order, by sums over its digests and input partitions first.

Defined results: a null text has no tokens and is taken with its leaf at no cost while the leaf has any budget; null
domain, language or source is a value of its own; nodes without a weight have weight 1; a weight of 0 anywhere above a
leaf gives it nothing, and its supply is no part of what its ancestors can take, so that their budget goes to others;
equal rows (doc_id, text and levels) stand one after the other in the order and are counted and taken row by row; other
columns, whatever their names, pass through ``mix``; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

LEVELS = ("domain", "lang", "source")
NONE = "(none)"
DIGITS = 2  # hex digits told apart at a time: at most 256 buckets for each leaf
STEPS = 4


def domain_of(source: str = "source") -> str:
    """Default domain of a source, as SQL: the last digit of its number deals the sources over three domains."""
    return f"case when {source} is null then '{NONE}' when substr({source}, length({source}), 1) in ('0', '1', '2', '3') then 'web' when substr({source}, length({source}), 1) in ('4', '5', '6') then 'books' else 'forum' end"


#: Default weights by level; names that are missing have weight 1.
WEIGHTS = {"domain": {"web": 5.0, "books": 3.0, "forum": 2.0}, "lang": {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "source": {"src0": 2.0}}


def weight_of(level: str, weights: dict[str, dict[str, float]]):
    out = F.lit(1.0)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def tokens_of(text: str = "text"):
    """Tokens of a text: runs of characters other than white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\r\n\x0B\f]+")), F.lit(0)).cast("long")


def budget_leaves(leaves: DataFrame, budget, weights: dict, max_epochs: int) -> DataFrame:
    """``leaves`` (levels, supply) with ``share``, the tokens each may take, level by level from the root.

    A leaf can take its supply ``max_epochs`` times if every weight from the root to it is positive, and nothing
    otherwise. Among siblings the share of child i is min(c_i, lambda w_i). Ordered by c_i / w_i, a child is full while
    c_i * (weights from it on) <= w_i * (budget - supply before it); lambda spreads what the full ones leave."""
    open_ = F.lit(True)
    for level in LEVELS:
        open_ = open_ & (weight_of(level, weights) > 0)
    caps = leaves.withColumn("cap", F.when(open_, F.col("supply") * F.lit(float(max_epochs))).otherwise(0.0))
    top = caps.agg(F.least(budget, F.sum("cap")).alias("share"))
    caps = caps.where("cap > 0")
    shares = top
    for depth, level in enumerate(LEVELS):
        above = list(LEVELS[:depth])
        nodes = caps.groupBy(*LEVELS[: depth + 1]).agg(F.sum("cap").alias("c")).withColumn("w", weight_of(level, weights))
        nodes = nodes.join(shares, above) if above else nodes.crossJoin(shares)  # one row: the root
        by = Window.partitionBy(*above).orderBy(F.col("c") / F.col("w"), level)
        before, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        nodes = nodes.withColumns({"used": F.coalesce(F.sum("c").over(before), F.lit(0.0)), "left": F.sum("w").over(onward)})
        nodes = nodes.withColumn("full", F.col("c") * F.col("left") <= F.col("w") * (F.col("share") - F.col("used")))
        own = Window.partitionBy(*above)
        nodes = nodes.withColumns({"taken": F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(own), F.lit(0.0)), "open": F.sum(F.when(~F.col("full"), F.col("w"))).over(own)})
        got = F.when(F.col("full"), F.col("c")).otherwise((F.col("share") - F.col("taken")) * F.col("w") / F.col("open"))
        shares = nodes.select(*LEVELS[: depth + 1], got.alias("share"))
    return leaves.join(shares, list(LEVELS), "left").withColumn("share", F.floor(F.coalesce("share", F.lit(0.0)) + F.lit(1e-6)))


def decide(rows: DataFrame, fraction: float, weights: dict, max_epochs: int, seed: int) -> DataFrame:
    """``rows`` (key, digest, levels, n_tokens, part, and any others) with ``copies``, how often each is taken. ``part``
    is the partition a row was read from, the same whenever it is read."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"))
    budget = F.lit(float(fraction)) * F.sum("supply")
    leaves = store(budget_leaves(leaves, budget, weights, max_epochs), "mix-leaves")
    leaves = leaves.withColumns({"epochs": F.when(F.col("supply") > 0, F.floor(F.col("share") / F.col("supply"))).otherwise(F.lit(0)).cast("int")})
    leaves = leaves.withColumn("rest", (F.col("share") - F.col("epochs") * F.col("supply")).cast("long")).select(*LEVELS, "epochs", "rest")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("key").cast("string"), F.lit("")), "digest"))
    ranked = rows.join(leaves, list(LEVELS)).withColumn("place", order)
    # the bucket in which the rest ends, by leading digits of the order
    cut = leaves.select(*LEVELS, F.lit("").alias("prefix"), F.col("rest").alias("room"))
    for depth in range(1, STEPS + 1):
        at = F.substring("place", 1, DIGITS * depth)
        inside = ranked.select(*LEVELS, "place", "n_tokens").join(cut, list(LEVELS)).where(F.substring("place", 1, DIGITS * (depth - 1)) == F.col("prefix"))
        sums = inside.groupBy(*LEVELS, at.alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.first("room").alias("room"))
        by = Window.partitionBy(*LEVELS).orderBy("bucket")
        sums = sums.withColumn("before", F.sum("n").over(by) - F.col("n"))
        # the first bucket that doesn't fit whole; where all fit, what comes after the last
        fit = sums.groupBy(*LEVELS).agg(F.min(F.when(F.col("before") + F.col("n") > F.col("room"), F.struct("bucket", (F.col("room") - F.col("before")).alias("room")))).alias("x"))
        cut = fit.select(*LEVELS, F.coalesce("x.bucket", F.lit("~")).alias("prefix"), F.coalesce("x.room", F.lit(0)).alias("room"))
        cut = store(cut, "mix-cut")
    at = F.substring("place", 1, DIGITS * STEPS)
    both = ranked.join(cut, list(LEVELS), "left").withColumns({"prefix": F.coalesce("prefix", F.lit("~")), "room": F.coalesce("room", F.lit(0))})  # a leaf without tokens has no cut
    # the last bucket: what stands before each (digest, partition), then within them; equal rows may be very many
    edge = both.where(at == F.col("prefix"))
    by = Window.partitionBy(*LEVELS).orderBy("place", "part")
    sums = edge.groupBy(*LEVELS, "place", "part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(by) - F.col("n")).drop("n")
    by = Window.partitionBy(*LEVELS, "place", "part").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.join(sums, [*LEVELS, "place", "part"])
    edge = edge.withColumn("last", (F.col("before") + F.sum("n_tokens").over(by) <= F.col("room")).cast("int")).drop("before")
    inner = both.where(at != F.col("prefix")).withColumn("last", (at < F.col("prefix")).cast("int"))
    out = inner.unionByName(edge)
    copies = (F.col("epochs") + F.when(F.col("rest") > 0, F.col("last")).otherwise(0)).cast("long")
    return out.select(*rows.columns, copies.alias("copies"))


def rows_of(docs: DataFrame, domain: str | None, text: str, key: str, whole: bool) -> DataFrame:
    """(key, digest, levels, n_tokens, part) of each row; with ``whole``, the row itself as ``row``. Written, so that a
    row keeps its ``part``."""
    levels = [F.coalesce(F.expr(domain or domain_of()), F.lit(NONE)).alias("domain"), *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in LEVELS[1:]]]
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    rows = docs.select(F.col(key).alias("key"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), *levels, tokens_of(text).alias("n_tokens"), *own)
    return store(rows.withColumn("part", F.spark_partition_id()), "mix-rows")


def plan(docs: DataFrame, fraction: float = 0.8, weights: dict | None = None, max_epochs: int = 2, seed: int = 17, domain: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row columns key, digest, levels, n_tokens, copies): how often each row is taken; ``fraction`` of all tokens is
    the budget."""
    out = decide(rows_of(docs, domain, text, key, False), fraction, WEIGHTS if weights is None else weights, max_epochs, seed)
    return out.drop("part").withColumnRenamed("key", key)


def mix(docs: DataFrame, fraction: float = 0.8, weights: dict | None = None, max_epochs: int = 2, seed: int = 17, domain: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``plan`` takes, each as often as it says."""
    out = decide(rows_of(docs, domain, text, key, True), fraction, WEIGHTS if weights is None else weights, max_epochs, seed)
    again = out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("again"))
    return again.select("row.*")


def oracle(fraction: float = 0.8, weights: dict | None = None, max_epochs: int = 2, seed: int = 17, table: str = "documents") -> str:
    """The plan from its definition, as SQL: siblings share by f(lambda) = sum of min(c, lambda w), whose value is taken
    at every sibling's own c / w; lambda lies where f reaches the budget. Each leaf is sorted whole."""
    weights = WEIGHTS if weights is None else weights

    def weight(level: str) -> str:
        own = weights.get(level)
        return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}::DOUBLE" for k, v in own.items()) + " ELSE 1.0::DOUBLE END" if own else "1.0::DOUBLE"

    sql = f"""
WITH rows0 AS (SELECT doc_id, md5(coalesce(text, '')) AS digest, {domain_of()} AS domain, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n\\x0B\\f]+'))::BIGINT AS n_tokens FROM {table}),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply FROM rows0 GROUP BY domain, lang, source),
able AS (SELECT domain, lang, source, supply * {max_epochs}.0::DOUBLE AS c FROM leaves WHERE supply > 0 AND {" AND ".join(f"{weight(x)} > 0" for x in LEVELS)}),
s0 AS (SELECT 1 AS root, least({fraction}::DOUBLE * (SELECT sum(supply) FROM leaves), coalesce(sum(c), 0)) AS share FROM able),"""
    for d, level in enumerate(LEVELS, 1):
        keys, up = ", ".join(LEVELS[:d]), ", ".join(LEVELS[: d - 1]) or "root"
        same = " AND ".join(f"a.{x} = b.{x}" for x in LEVELS[: d - 1]) or "true"
        root = "1 AS root, " if d == 1 else ""
        sql += f"""
n{d} AS (SELECT * FROM (SELECT {root}{keys}, sum(c) AS c, {weight(level)} AS w FROM able GROUP BY {keys}) JOIN s{d - 1} USING ({up})),
f{d} AS (SELECT {", ".join(f"a.{x}" for x in (LEVELS[: d - 1] or ["root"]))}, a.knee, sum(least(b.c, a.knee * b.w)) AS f, sum(CASE WHEN b.c / b.w > a.knee THEN b.w ELSE 0 END) AS slope, any_value(a.share) AS share FROM (SELECT DISTINCT {up}, share, c / w AS knee FROM n{d}) a JOIN n{d} b ON {same} GROUP BY ALL),
m{d} AS (SELECT {up}, max(share) AS share, max(CASE WHEN f <= share THEN knee END) AS knee, arg_max(f, CASE WHEN f <= share THEN knee END) AS f, arg_max(slope, CASE WHEN f <= share THEN knee END) AS slope FROM f{d} GROUP BY {up}),
w{d} AS (SELECT {up}, sum(w) AS w FROM n{d} GROUP BY {up}),
k{d} AS (SELECT {up}, CASE WHEN knee IS NULL THEN share / w WHEN slope > 0 THEN knee + (share - f) / slope ELSE knee END AS water FROM m{d} JOIN w{d} USING ({up})),
s{d} AS (SELECT {keys}, least(c, water * w) AS share FROM n{d} JOIN k{d} USING ({up})),"""
    return sql + f"""
l AS (SELECT domain, lang, source, supply, floor(coalesce(share, 0) + 0.000001) AS share FROM leaves LEFT JOIN s{len(LEVELS)} USING (domain, lang, source)),
e AS (SELECT *, CASE WHEN supply > 0 THEN floor(share / supply)::INT ELSE 0 END AS epochs FROM l),
o AS (SELECT r.*, epochs, (share - epochs * supply)::BIGINT AS rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('{seed}:', epochs, ':', doc_id, ':', digest)) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM rows0 r JOIN e USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM o"""
