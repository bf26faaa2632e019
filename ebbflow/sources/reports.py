"""What runs leave behind: feature panels, wide equity curves, a registry of runs, slices as JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import fnv1a, format_rfc3339
from ..operators import panel
from ..params import Params
from . import tables

#: Columns of the feature panel, in their order.
FEATURES = ("ret1", "ldv", "dvshock", "vol20", "pressure", "active", "elig", "label")


def feature_panel(bars: DataFrame, params: Params, horizon: int, window: int = 20, floor: float = 0.0, top_n: int = 1 << 30) -> DataFrame:
    """(bar_idx, ticker, FEATURES) of every ticker on every bar: features, the pressure that the flow takes, whether the node
    is active and eligible, and the forward return over ``horizon`` bars."""
    from ..operators import frames

    grid = tables.dense(bars)
    state = frames.activity(bars, params).select("bar_idx", "ticker", F.col("p").alias("pressure"), "active")
    elig = panel.eligible(grid, window, floor, top_n).select("bar_idx", "ticker", F.lit(True).alias("elig"))
    label = panel.forward_return(grid, horizon).select("bar_idx", "ticker", F.col("fwd").alias("label"))
    out = state.join(panel.features(bars).select("bar_idx", "ticker", *FEATURES[:4]), ["bar_idx", "ticker"], "left").join(elig, ["bar_idx", "ticker"], "left").join(label, ["bar_idx", "ticker"], "left")
    return out.withColumn("elig", F.coalesce("elig", F.lit(False))).select("bar_idx", "ticker", *FEATURES)


def write_panel(features: DataFrame, path: str, meta: dict) -> None:
    """The feature panel as Parquet, and beside it its columns and ``meta`` as JSON."""
    features.sortWithinPartitions("bar_idx", "ticker").write.mode("overwrite").parquet(f"{path}/panel")
    spark = features.sparkSession
    text = json.dumps(meta | {"columns": list(features.columns)}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_panel(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The panel and its meta; raises where columns are missing."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    rows = spark.read.parquet(f"{path}/panel")
    if missing := set(meta["columns"]) - set(rows.columns):
        raise ValueError(f"the panel at {path} lacks {sorted(missing)}")
    return rows, meta


def truncated(rows: DataFrame, end: int) -> DataFrame:
    """A panel as it was known before bar ``end``."""
    return rows.where(F.col("bar_idx") < end)


def wide(curves: DataFrame, names: list[str]) -> DataFrame:
    """(t, one column for each named curve): value curves (strategy, t, value) side by side."""
    return curves.groupBy("t").pivot("strategy", names).agg(F.first("value"))


def long(equity: DataFrame) -> DataFrame:
    """(strategy, t, value) of curves side by side."""
    names = [c for c in equity.columns if c != "t"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("strategy"), F.col(c).alias("value")) for c in names]))
    return equity.select("t", pairs.alias("x")).select("x.strategy", "t", "x.value").where("value is not null")


def params_hash(params: Params) -> str:
    """A digest that is the same for the same parameters."""
    return fnv1a(repr(params))


def replace_runs(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with the rows of the new runs in place of those of the same run and parameters; older rows may lack the
    newer columns. Raises if a run comes with other parameters."""
    known = registry.select("run_id", F.col("params_hash").alias("was")).distinct().join(new.select("run_id", "params_hash").distinct(), "run_id")
    if known.where("was <> params_hash").limit(1).count():
        raise ValueError("a run of that name has other parameters")
    kept = registry.join(new.select("run_id").distinct(), "run_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def with_ratio(registry: DataFrame, curves: DataFrame, bench: str) -> DataFrame:
    """The registry (run_id, strategy, ...) with ir_daily from each run's curves (run_id, strategy, t, value) against the
    curve ``bench``, where it lacks it; returns go by each curve's own value before."""
    w = Window.partitionBy("run_id", "strategy").orderBy("t")
    r = curves.withColumn("r", F.col("value") / F.lag("value").over(w) - 1).where("r is not null")
    b = r.where(F.col("strategy") == bench).select("run_id", "t", F.col("r").alias("rb"))
    d = r.join(b, ["run_id", "t"]).withColumn("d", F.col("r") - F.col("rb")).groupBy("run_id", "strategy").agg(F.try_divide(F.avg("d"), F.nullif(F.stddev_samp("d"), F.lit(0.0))).alias("ir"))
    rows = registry.join(d, ["run_id", "strategy"], "left")
    old = F.col("ir_daily") if "ir_daily" in registry.columns else F.lit(None).cast("double")
    return rows.withColumn("ir_daily", F.coalesce(old, "ir")).drop("ir")


def slice_json(nodes: DataFrame, edges: DataFrame, t: int) -> DataFrame:
    """One row (value): a slice of a few nodes (node, pi) and the edges (src, dst, p) among them as JSON, in their order."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("node", "pi"))).alias("nodes"))  # a slice: a few nodes
    e = edges.agg(F.array_sort(F.collect_list(F.struct("src", "dst", "p"))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct(format_rfc3339(F.lit(t)).alias("time"), "nodes", "edges")).alias("value"))


def markdown(table: DataFrame, columns: list[str], digits: int = 4) -> str:
    """A small table as Markdown."""
    rows = table.select(*columns).collect()  # a report's table

    def cell(v):
        return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]) + "\n"


def latest_store(store: DataFrame, cutoff) -> DataFrame:
    """Rows of the newest run not after ``cutoff`` of a store (cutoff, ...) of graphs or predictions."""
    fine = store.where(F.col("cutoff") <= cutoff)
    last = fine.agg(F.max("cutoff").alias("last"))
    return fine.join(last, fine["cutoff"] == last["last"], "left_semi")


def predictions(store: DataFrame) -> DataFrame:
    """Predictions (cutoff, t, ticker, score) put together: of a (t, ticker) that several runs predict, the newest's."""
    last = F.max_by("score", "cutoff").alias("score")
    return store.groupBy("t", "ticker").agg(last)


def graph_rows(edges: DataFrame, per: str = "src") -> DataFrame:
    """(src, dst, w, rank): edges with their rank in their row, the heaviest first."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(F.desc("w"), "dst" if per == "src" else "src")))


def retrain_blocks(calendar: DataFrame, first: int, every: int, embargo: int) -> DataFrame:
    """(block, train_end, start, end): retraining every ``every`` bars from ``first`` on, on labels that end ``embargo`` bars
    before, to predict the bars [start, end)."""
    end = calendar.agg((F.max("bar_idx") + 1).alias("stop"))
    starts = end.where(F.col("stop") > first).select(F.explode(F.sequence(F.lit(first), F.col("stop") - 1, F.lit(every))).alias("start"), "stop")
    return starts.select(((F.col("start") - first) / every).cast("long").alias("block"), (F.col("start") - embargo).cast("long").alias("train_end"), F.col("start").cast("long").alias("start"), F.least(F.col("start") + every, F.col("stop")).cast("long").alias("end"))


def node_set(features: DataFrame, most: int, labelled: bool = True) -> DataFrame:
    """(bar_idx, ticker, place): the active, eligible (and labelled) names of each bar, the ``most`` largest by ldv, ties to
    the smaller name."""
    fine = F.col("active") & F.col("elig") & (F.col("label").isNotNull() if labelled else F.lit(True))
    place = F.row_number().over(Window.partitionBy("bar_idx").orderBy(F.desc("ldv"), "ticker"))
    return features.where(fine).withColumn("place", place).where(F.col("place") <= most).select("bar_idx", "ticker", "place")


def check_run_id(name: str) -> str:
    """The name of a run, of letters, digits and _ . - alone, 64 at most."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]{1,64}", name) or name in (".", ".."):
        raise ValueError(f"not a run id: {name!r}")
    return name


def same_calendar(stored: DataFrame, now: DataFrame) -> bool:
    """Whether a stored calendar (bar_idx, t) is a prefix of the one now: what was learned on it can be carried on."""
    both = stored.select("bar_idx", F.col("t").alias("was")).join(now.select("bar_idx", "t"), "bar_idx", "left")
    return both.where("t is null or t <> was").limit(1).count() == 0
