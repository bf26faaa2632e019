import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbflow import catalog, params
from ebbflow.operators import flux, graph, holdings, panel, sessions, stats, walkforward
from ebbflow.sources import lake, tables

GOLDEN = [(1, 2, 5e5), (1, 3, 1e5), (2, 1, 2e5), (2, 3, 1e6), (3, 1, 7.5e5), (3, 2, 4e5)]


@pytest.fixture(scope="module")
def chain(spark):
    e = spark.createDataFrame(GOLDEN, "src long, dst long, w double")
    return flux.transition(e), spark.createDataFrame([(1,), (2,), (3,)], "node long")


def pi_of(df):
    return {r.node: r.pi for r in df.collect()}


def test_golden_chain_after_seven_steps_and_converged(chain):
    p, nodes = chain
    for steps, want, tol in ((7, {1: 0.29248, 2: 0.35980, 3: 0.34770}, 5e-5), (None, {1: 0.29319, 2: 0.36016, 3: 0.34665}, 1e-5)):
        got = pi_of(flux.stationary(nodes, p, steps=steps))
        assert all(math.isclose(got[k], v, abs_tol=tol) for k, v in want.items())


def test_large_graphs_take_the_stepwise_way_with_the_same_result(chain):
    p, nodes = chain
    small, large = pi_of(flux.stationary(nodes, p, steps=2)), pi_of(flux.stationary(nodes, p, steps=2, local_edges=0))
    assert all(math.isclose(small[k], large[k], rel_tol=1e-12) for k in small)


def test_dead_ends_teleport(spark):
    p = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, p double")
    got = pi_of(flux.stationary(spark.createDataFrame([(1,), (2,)], "node long"), p))
    assert math.isclose(sum(got.values()), 1.0) and got[2] > got[1]


def test_returns_skip_gaps(spark):
    b = spark.createDataFrame([(0, 1, 10.0), (1, 1, 11.0), (3, 1, 12.0)], "bar_idx int, ticker long, c double")
    got = {r.bar_idx: r.r for r in panel.returns(b).collect()}
    assert got[0] is None and math.isclose(got[1], 0.1) and got[3] is None


def test_rolling_corr_runs_over_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(b, t, t + 1, 1 + b % 3, 5.0, 5.0 * float(rng.uniform(10, 20)), f"{1995 + b // 12}-{b % 12 + 1:02d}-03") for b in range(20) for t in range(1, 16) if t != 14 or b != 6]
    li = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, d string")
    li.withColumn("l_shipdate", F.to_timestamp_ntz("d")).drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")
    r = {}
    for b, t, _, _, q, x, _ in rows:
        r[b, t] = x / q
    r = {(b, t): c / r[b - 1, t] - 1 if (b - 1, t) in r else 0.0 for (b, t), c in r.items()}
    want = {}
    for a in range(1, 16):
        for b in range(a + 1, 16):
            for bar in range(20):
                past = [k for k in range(bar - 12, bar) if (k, a) in r and (k, b) in r]
                if len(past) == 12 and (bar, a) in r and (bar, b) in r:
                    want[bar, a, b] = np.corrcoef([r[k, a] for k in past], [r[k, b] for k in past])[0, 1]
    got = {(x.bar_idx, x.a, x.b): x.corr for x in catalog.rolling_corr(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and max(b for _, _, b in got) == 15
    assert all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)


def test_rolling_corr_of_the_first_twelve_matches_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    want = {(b, x, y): c for b, x, y, c in con.execute(catalog.ROLLING_CORR_12).fetchall()}
    got = {(x.bar_idx, x.a, x.b): x.corr for x in catalog.rolling_corr(spark, sf).where("b <= 12").collect()}
    assert got.keys() == want.keys() and all(got[k] == want[k] or math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)


def test_flux_conserves_what_is_sold(spark):
    p = spark.createDataFrame([(0, 1, -3.0), (0, 2, -1.0), (0, 3, 4.0), (0, 4, 1.0), (1, 1, 0.0)], "bar_idx int, ticker long, p double")
    out = flux.bar_flux(p).groupBy("src").agg(F.sum("w").alias("w")).collect()
    assert {r.src: round(r.w, 9) for r in out} == {1: 3.0, 2: 1.0}
    assert math.isclose(flux.margins(p).agg(F.sum("inflow")).first()[0], 4.0)


def test_capped_fold_equals_closed_form_without_a_cap(spark):
    f = spark.createDataFrame([(0, 1, 2, 4.0), (2, 1, 2, 1.0), (1, 1, 3, 2.0)], "bar_idx int, src long, dst long, w double")
    a = {(r.src, r.dst): r.w for r in flux.accumulate(f, 3, 2).collect()}
    b = {(r.src, r.dst): r.w for r in flux.capped_fold(f, 3, 2, 10).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-12) for k in a)
    assert flux.capped_fold(f, 3, 2, 1).count() == 1


def test_tilt_of_zero_is_the_plain_flux(spark):
    rows = [(b, t, (t - 2) * 0.01 * (1 + b % 3)) for b in range(6) for t in (1, 2, 3, 4)]
    r = spark.createDataFrame(rows, "bar_idx int, ticker long, r double")
    p = r.select("bar_idx", "ticker", F.col("r").alias("p"))
    tilted = {(x.bar_idx, x.src, x.dst): x.w for x in flux.tilted_flux(p, r, 3, 0.0).collect()}
    plain = {(x.bar_idx, x.src, x.dst): x.w for x in flux.bar_flux(p).where("bar_idx >= 3").collect()}
    assert tilted.keys() == plain.keys() and all(math.isclose(tilted[k], plain[k], rel_tol=1e-9) for k in plain)


def test_tilted_flux_of_sparse_tickers_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    r = {(b, t): float(rng.standard_normal() * 0.02) for b in range(9) for t in range(1, 8) if t < 5 or rng.random() < 0.6 and (t != 7 or b > 5)}
    window, tilt, want = 4, 0.8, {}
    for bar in range(9):
        p = {t: r[b, t] * (10 + t) for b, t in r if b == bar}
        u = {}
        for t in p:
            x = np.array([r.get((b, t), 0.0) for b in range(max(0, bar - window), bar)])
            x = x - x.mean() if len(x) > 1 else np.zeros(1)
            u[t] = x / np.sqrt(x @ x) if x @ x >= 1e-24 else x * 0
        for i in (t for t in p if p[t] < 0):
            score = {j: p[j] * (1 + tilt * u[i] @ u[j]) for j in p if p[j] > 0}
            want |= {(bar, i, j): -p[i] * w / sum(score.values()) for j, w in score.items() if w > 0 and sum(score.values()) > 0}
    rets = spark.createDataFrame([(*k, v) for k, v in r.items()], "bar_idx int, ticker long, r double")
    pressure = rets.select("bar_idx", "ticker", (F.col("r") * (10 + F.col("ticker"))).alias("p"))
    got = {(x.bar_idx, x.src, x.dst): x.w for x in flux.tilted_flux(pressure, rets, window, tilt, warmup=0).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_causality_of_the_eligible_set(spark):
    rows = [(b, t, 10.0 + t + b, 5.0) for b in range(12) for t in (1, 2, 3)]
    full = spark.createDataFrame(rows, "bar_idx int, ticker long, vw double, v double").withColumn("t", F.col("bar_idx"))
    cut = full.where("bar_idx < 8")
    a = {(r.bar_idx, r.ticker, r.place) for r in panel.eligible(tables.dense(full), 4, 0.0, 2).where("bar_idx < 8").collect()}
    assert a == {(r.bar_idx, r.ticker, r.place) for r in panel.eligible(tables.dense(cut), 4, 0.0, 2).collect()}


def test_spearman_of_few_pairs_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 1.0), (2, 1.0, 1.0), (2, 2.0, 2.0), (2, 3.0, 3.0)], "g int, x double, y double")
    got = {r.g: r.ic for r in stats.spearman(df, "x", "y", ["g"]).collect()}
    assert got[1] is None and math.isclose(got[2], 1.0)


def test_inverse_normal(spark):
    got = spark.createDataFrame([(0.975,), (0.5,), (0.001,)], "p double").select(stats.norm_inv(F.col("p")).alias("z")).collect()
    assert all(math.isclose(g.z, w, abs_tol=1e-6) for g, w in zip(got, (1.959964, 0.0, -3.090232), strict=True))


def test_identical_partitions_agree(spark):
    df = spark.createDataFrame([(i, i % 3, (i % 3) + 5) for i in range(30)], "i int, a int, b int")
    r = stats.partition_agreement(df, "a", "b").first()
    assert math.isclose(r.nmi, 1.0) and math.isclose(r.ari, 1.0)


def test_louvain_finds_planted_groups(spark):
    rows = [(a, b, 5.0 if a // 10 == b // 10 else 0.05) for a in range(30) for b in range(30) if a != b]
    got = {r.node: r.community for r in graph.louvain(spark.createDataFrame(rows, "src long, dst long, w double")).collect()}
    assert got == {v: v // 10 * 10 for v in range(30)}


def test_observed_flows_balanced(spark):
    rows = [("q1", 1, "A", 20.0, 200.0), ("q2", 1, "A", 10.0, 100.0), ("q1", 1, "B", 1.0, 10.0), ("q2", 1, "B", 7.0, 70.0), ("q1", 1, "C", 1.0, 10.0), ("q2", 1, "C", 5.0, 50.0)]
    h = spark.createDataFrame(rows, "quarter string, cik long, ticker string, shares double, value_usd double")
    got = {(r.src, r.dst): round(r.w, 6) for r in holdings.observed_flows(h, "q1", "q2").collect()}
    assert got == {("A", "B"): 60.0, ("A", "C"): 40.0}


def test_session_filter_and_early_close(spark):
    rows = [("2024-01-02 14:00:00",), ("2024-01-02 14:30:00",), ("2024-01-02 20:30:00",), ("2024-01-02 21:00:00",), ("2024-01-06 15:00:00",), ("2024-11-29 17:30:00",), ("2024-11-29 18:00:00",), ("2024-07-02 13:30:00",)]
    df = spark.createDataFrame(rows, "s string").select(F.to_timestamp("s").alias("ts"))
    got = [r.ok for r in df.select(sessions.regular(F.col("ts"), 30).alias("ok")).collect()]
    assert got == [False, True, True, False, False, True, False, True]


def test_lake_upsert_compaction_and_retention(spark, tmp_path):
    path = str(tmp_path / "lake")
    row = lambda t, c: ("A", t, c, c, c, c, 1.0, c)
    kind = "ticker string, t long, o double, h double, l double, c double, v double, vw double"
    day = 86_400
    lake.write(spark.createDataFrame([row(0, 1 / 3), row(40 * day, 2.0)], kind), path, "1d", 1)
    lake.write(spark.createDataFrame([row(0, 5.0)], kind), path, "1d", 2)
    got = {r.t: r.c for r in lake.read(spark, path, "1d", 0, 50 * day).collect()}
    assert got == {0: 5.0, 40 * day: 2.0}
    assert lake.read(spark, path, "1d", 0, day).count() == 1
    assert lake.file_count(spark, path, "1d") == 3 and lake.compact(spark, path, "1d") == 1 and lake.file_count(spark, path, "1d") == 2
    assert spark.read.parquet(path).count() == 2 and lake.next_seq(spark, path) == 3
    assert {r.t: r.c for r in lake.read(spark, path, "1d", 0, 50 * day).collect()} == got
    assert [(r.year, r.month) for r in lake.retained(spark, path, "1d", 32 * day).collect()] == [(1970, 1)]
    assert lake.retain(spark, path, {"1d": 10, "1h": 5, "1w": None}, 45 * day) == 1 and spark.read.parquet(path).count() == 1


def test_vendor_page(spark):
    page = '{"bars": {"A": [{"t": "2024-01-02T15:00:00Z", "o": 1, "h": 2, "l": 1, "c": 2, "v": 10}]}, "next_page_token": null}'
    r = lake.bars_page(spark.createDataFrame([(page,)], "value string")).first()
    assert (r.ticker, r.t, r.c, r.vw) == ("A", 1704207600, 2.0, 0.0)


def test_simulation_of_a_rising_ticker_beats_cash(spark):
    prices = spark.createDataFrame([(t, k, 10.0 + t * (k == 1), 10.0 + t * (k == 1)) for t in range(10) for k in (1, 2)], "t int, ticker long, o double, c double")
    targets = spark.createDataFrame([("up", 0, 1, 1.0), ("flat", 0, 2, 1.0)], "strategy string, t int, ticker long, w double")
    got = {(r.strategy, r.t): r.value for r in walkforward.simulate(prices, targets, turnover_cap=1.0).collect()}
    assert got[("up", 9)] > 1.5 and 0.99 < got[("flat", 9)] < 1.0


def test_presets_validate():
    assert params.rank_preset().dangling == "teleport" and params.intraday().horizons == (1, 6, 26)
    with pytest.raises(ValueError):
        params.Params(alpha=1.5)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
