import math
import random

import numpy as np
import pandas as pd
import pytest
from helpers import mids
from pyspark.sql import Window
from pyspark.sql import functions as F

from lobwright.operators.chunks import ChunkSql, add_rolling_z, drop_halo, with_halo
from lobwright.operators.features import (
    LOOK_BACK,
    depth_features,
    distance_features,
    level_vector,
    level_windows,
    price_features,
    return_features,
    sequence_features,
    small_feature_set,
    with_group_position,
)
from lobwright.operators.index import event_index
from lobwright.operators.labels import add_labels
from lobwright.operators.quantiles import group_quantiles
from lobwright.operators.regimes import run_lengths
from lobwright.operators.resample import bootstrap_table, daily_by_policy, paired_day_bootstrap
from lobwright.operators.tune import hash_sample
from lobwright.plans.chain import indexed_book

SF01 = "/root/testdata/sf0.01"


def returns(df, chunk_rows=65_536):
    win = ChunkSql()
    return drop_halo(return_features(with_halo(df, back=LOOK_BACK, chunk_rows=chunk_rows), win))


def test_rolling_statistics_equal_pandas(spark):
    mid = pd.Series([100 + math.sin(i / 13) + 0.001 * i for i in range(700)])
    got = returns(mids(spark, mid)).orderBy("event_idx").toPandas()
    r = mid.pct_change().fillna(0.0)
    for n in (20, 100, 500):
        need = max(2, n // 4)
        assert got[f"realized_vol_{n}"].to_numpy() == pytest.approx(r.rolling(n, min_periods=need).std().fillna(0).to_numpy(), abs=1e-12)
        assert got[f"abs_return_{n}"].to_numpy() == pytest.approx(r.abs().rolling(n, min_periods=need).sum().fillna(0).to_numpy(), abs=1e-12)
        corr = r.shift(1).rolling(n - 1, min_periods=max(2, need - 1)).corr(r).fillna(0.0)
        assert got[f"return_autocorr_{n}"].to_numpy() == pytest.approx(corr.to_numpy(), abs=1e-6)


def test_rolling_statistics_do_not_depend_on_chunks(spark):
    """Violent moves, then moves of 1e-9: running sums would keep the error of the first in the second."""
    rnd, mid = random.Random(8), [100.0]
    for i in range(3000):
        mid.append(mid[-1] * (1 + rnd.uniform(-1, 1) * (0.01 if i < 1500 else 1e-9)))
    rows = mids(spark, mid)
    r = np.array([0.0, *[b / a - 1 for a, b in zip(mid, mid[1:])]])
    for chunk in (1_000, 2_000, 65_536):
        got = returns(rows, chunk).orderBy("event_idx").toPandas()
        for n in (20, 100, 500):
            want = np.array([np.std(r[i - n + 1 : i + 1], ddof=1) for i in range(n, len(r))])
            assert got[f"realized_vol_{n}"].to_numpy()[n:] == pytest.approx(want, rel=1e-9)
        want = np.array([np.corrcoef(r[i - 99 : i], r[i - 98 : i + 1])[0, 1] for i in range(2000, 2100)])
        assert got["return_autocorr_100"].to_numpy()[2000:2100] == pytest.approx(want, rel=1e-9)


def test_constant_series_gives_zeros(spark):
    got = returns(mids(spark, [100.0] * 300)).toPandas()
    for c in ("realized_vol_100", "return_autocorr_100", "mid_return_50"):
        assert (got[c] == 0).all()


def test_features_do_not_see_the_future(spark):
    values = [100 + math.cos(i / 9) + 0.002 * i for i in range(240)]
    whole = returns(mids(spark, values)).filter("event_idx < 180").orderBy("event_idx").toPandas()
    prefix = returns(mids(spark, values[:180])).orderBy("event_idx").toPandas()
    cols = [c for c in whole.columns if c not in ("exchange", "symbol")]
    assert np.allclose(whole[cols].astype(float), prefix[cols].astype(float), atol=1e-15)


def test_chunks_equal_one_piece(spark):
    rows = distance_features(depth_features(price_features(indexed_book(spark, SF01)))).cache()
    names = ["ofi_1", "ofi_10", "mid_return_100", "realized_vol_500", "return_autocorr_500", "up_down_flip_rate_100",
             "vol_score", "spread_z_1m", "depth_z_1m", "momentum_score", "adverse_selection_score", "ofi_proxy_score",
             "depth_drop_top10", "spread_widening_flag"]

    def run(c):
        return sequence_features(rows, chunk_rows=c, columns=("symbol", "event_idx", *names)).orderBy("symbol", "event_idx").toPandas()

    one, cut = run(10**9), run(600)
    assert len(one) == len(cut) == 10_000
    assert np.abs(one[names].astype(float).to_numpy() - cut[names].astype(float).to_numpy()).max() < 1e-8
    small = [small_feature_set(rows.select("exchange", "symbol", "event_idx", "bids", "asks"), c)
             .select("symbol", "event_idx", "realized_vol_100", "depth_z_100", "momentum_score").orderBy("symbol", "event_idx").toPandas()
             for c in (10**9, 300)]
    assert np.abs(small[0].iloc[:, 2:].to_numpy() - small[1].iloc[:, 2:].to_numpy()).max() < 1e-8
    rows.unpersist()


def test_event_index_in_buckets_and_bursts(spark):
    rnd = random.Random(1)
    rows = [("X", rnd.choice("ab"), 5_000_000 if rnd.random() < 0.4 else rnd.randrange(10**8), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, event_us long, sequence_number long")
    want = df.withColumn(
        "want", F.row_number().over(Window.partitionBy("symbol").orderBy("event_us", "sequence_number")) - 1
    )
    for layout in (1, 7):
        got = event_index(want.repartition(layout))
        assert got.count() == 4000 and got.filter("event_idx <> want").count() == 0
    with pytest.raises(ValueError):
        event_index(df.withColumn("symbol", F.lit(None).cast("string")))


def test_event_index_keeps_every_row_of_a_burst(spark):
    """One microsecond with equal, missing and repeated sequences: no row is lost, and no layout changes an index."""
    rows = [("X", "S", 7_000_000, None if i % 10 == 0 else 3, i % 50, float(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, event_us long, sequence_number long, arrival long, value double")
    found = []
    for layout in (1, 6):
        out = event_index(df.repartition(layout, "value")).select("event_idx", "value").collect()
        assert sorted(r["event_idx"] for r in out) == list(range(5000))
        found.append(sorted((r["event_idx"], r["value"]) for r in out))
    assert found[0] == found[1]


def test_missing_times_come_first_if_allowed(spark):
    df = spark.createDataFrame([("X", "S", 5, 1), ("X", "S", None, 2), ("X", "S", None, 1)], "exchange string, symbol string, event_us long, sequence_number long")
    with pytest.raises(ValueError):
        event_index(df)
    got = sorted((r["event_idx"], r["event_us"], r["sequence_number"]) for r in event_index(df, missing_time=True).collect())
    assert got == [(0, None, 1), (1, None, 2), (2, 5, 1)]


def test_labels_goldens(spark):
    def label(mid1, rel=0.001, fee=1.0, buffer=0.5):
        df = mids(spark, [100.0, mid1]).withColumn("rel_spread", F.lit(rel))
        return add_labels(df, 1, fee, buffer).first()

    assert label(100.17).label == "UP" and label(99.83).label == "DOWN" and label(100.15).label == "FLAT"
    assert label(100.17).cost_threshold_t == pytest.approx(0.0016)
    assert label(101.0, 0.01, 0.0, 0.0).label == "FLAT"
    out = add_labels(mids(spark, [100, 100, 101, 102]), 1, 0.0, 0.0).orderBy("event_idx").toPandas()
    assert len(out) == 3 and out.future_ret_h[0] == 0 and out.future_ret_h[1] > 0


def test_counted_quantiles_are_exact(spark):
    rnd = random.Random(5)
    rows = [(k, 7.0 if rnd.random() < 0.35 else rnd.gauss(0, 3)) for k in "ab" for _ in range(3000)] + [("c", 1.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {f"q{int(q * 1000)}": (F.col("v"), q) for q in (0.0, 0.05, 0.5, 0.7, 0.999, 1.0)}
    a = group_quantiles(df, ["k"], wanted).orderBy("k").toPandas()
    b = group_quantiles(df, ["k"], wanted, exact_rows=0).orderBy("k").toPandas()
    assert np.array_equal(a[list(wanted)].to_numpy(), b[list(wanted)].to_numpy())


def test_counted_quantiles_of_odd_values(spark):
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), float("nan"), 1.0, 1.0 + 2**-52, -1.0]
    rows = [("a", 1, x, float(i)) for i, x in enumerate(odd)] + [("a", 1, None, 3.0), ("b", 1, None, 2.0), (None, 1, 4.0, None), (None, None, 4.5, 1.0)]
    df = spark.createDataFrame(rows, "_all string, w int, v double, u double")
    wanted = {f"{c}{int(q * 100)}": (F.col(c), q) for c in "vu" for q in (0.0, 0.1, 0.5, 0.9, 1.0)}
    for keys in (["w"], ["k", "w"], []):
        given = df.withColumnRenamed("_all", "k")
        a = group_quantiles(given, keys, wanted).orderBy(*keys, *wanted).toPandas()
        for bits in (16, 11):
            b = group_quantiles(given, keys, wanted, exact_rows=0, bits=bits).orderBy(*keys, *wanted).toPandas()
            assert a[keys].astype(str).equals(b[keys].astype(str))
            assert np.array_equal(a[list(wanted)].to_numpy(float), b[list(wanted)].to_numpy(float), equal_nan=True)
    empty = df.where("false")
    assert group_quantiles(empty, ["w"], wanted, exact_rows=-1).count() == 0
    assert group_quantiles(empty, [], wanted, exact_rows=-1).first() == group_quantiles(empty, [], wanted).first()


def test_counted_quantiles_by_keys_of_any_name(spark):
    rows = [(1, "a", float(i)) for i in range(7)] + [(1, None, 2.0), (2, "a", None)]
    df = spark.createDataFrame(rows, "_all int, _k0 string, v double")
    for keys in (["_all"], ["_all", "_k0"], ["_k0", "_all"]):
        a = group_quantiles(df, keys, {"q": (F.col("v"), 0.5)})
        b = group_quantiles(df, keys, {"q": (F.col("v"), 0.5)}, exact_rows=0)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_runs_over_chunk_seams(spark):
    rnd = random.Random(9)
    values = []
    while len(values) < 500:
        values += [rnd.choice("ABC")] * rnd.choice([1, 2, 5, 60])
    df = spark.createDataFrame([("X", "S", i, v) for i, v in enumerate(values)], "exchange string, symbol string, event_idx long, regime string")
    want, start = [], 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            want.append((start, values[start], i - start))
            start = i
    for c in (7, 10**6):
        got = run_lengths(df, chunk_rows=c).select("first_idx", "regime", "run_length").collect()
        assert sorted(tuple(r) for r in got) == want


def test_windows_stay_inside_days(spark):
    from helpers import book

    def windows(sizes):
        n = sum(sizes)
        days = [d for d, s in enumerate(sizes) for _ in range(s)]
        df = book(spark, n).withColumn("split", F.lit("train")).withColumn("label", F.lit("UP"))
        df = df.withColumn("date", F.element_at(F.array(*[F.lit(str(d)) for d in days]), (F.col("event_idx") + 1).cast("int")))
        return level_windows(with_group_position(df), level_vector(2), 3).select("window", "event_idx").collect()

    got = windows([5])
    assert len(got) == 3 and len(got[0].window) == 3 and len(got[0].window[0]) == 8
    assert len(windows([2, 2])) == 0 and len(windows([3, 3])) == 2


def test_bootstrap(spark):
    day = 86_400_000_000
    rows = [("risk_gate", d, v) for d, v in ((0, 3.0), (1, -1.0))] + [("cost_aware_threshold", d, v) for d, v in ((0, 1.0), (2, 4.0))]
    daily = spark.createDataFrame(
        [("S", p, str(d), v, 1) for p, d, v in rows], "symbol string, policy string, day string, net_pnl double, n_trades long"
    )
    policies = ("naive_threshold", "cost_aware_threshold", "risk_gate")
    days = daily_by_policy(daily, policies, ["symbol"])
    assert days.count() == 3 and days.agg(F.sum("net_0")).first()[0] == 0.0
    a, b = (paired_day_bootstrap(daily, "risk_gate", "cost_aware_threshold", ["symbol"], 200).first() for _ in range(2))
    assert a == b and a.n_days == 3 and a.mean_diff == pytest.approx(-1.0) and a.ci_low <= -1.0 <= a.ci_high
    t = bootstrap_table(daily, policies, ["symbol"], 200).filter("row_type = 'difference' and comparison_policy = 'cost_aware_threshold'").first()
    assert t.net_total == pytest.approx(-3.0) and t.n_days == 3
    assert day


def test_hash_sample_is_stable(spark):
    df = spark.range(20_000)
    a = hash_sample(df, F.col("id"), 0.1).count()
    assert a == hash_sample(df.repartition(13), F.col("id"), 0.1).count() and 1700 < a < 2300


def test_pieces_cover_a_window_once():
    from lobwright.operators.chunks import pieces

    for n in range(1, 1200):
        covered = sorted(k for rows, offset in pieces(n) for k in range(offset, offset + rows))
        assert covered == list(range(n)) and pieces(n)[0][1] == 0


@pytest.mark.parametrize("n", [7, 40, 100, 300, 499])
def test_rolling_z_after_a_level_shift(spark, n):
    """A window right after a jump of seven orders of magnitude, the same for every chunk size."""
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(1000, 1.0), 1e7 + 0.01 * rng.standard_normal(4000), np.full(700, 3.7)])
    df = spark.createDataFrame([("X", "s", i, float(v)) for i, v in enumerate(values)], "exchange string, symbol string, event_idx long, v double")
    x = pd.Series(values)
    windows = np.lib.stride_tricks.sliding_window_view(values, n)
    std = pd.Series(np.concatenate([np.full(n - 1, np.nan), windows.std(axis=1, ddof=1)]))
    mean = pd.Series(np.concatenate([np.full(n - 1, np.nan), windows.mean(axis=1)]))
    want = ((x - mean) / (std + 1e-9)).to_numpy()
    for c in (2000, 65_536):
        d = add_rolling_z(with_halo(df, back=501, chunk_rows=c), {"z": "v"}, ChunkSql(), n, n, 1e-9)
        got = drop_halo(d).orderBy("event_idx").toPandas()["z"].to_numpy()
        # A window across the jump, or of noise on 1e7, is known to about nine digits in doubles at best.
        assert np.nanmax(np.abs(got - want)[n - 1 :]) < 1e-5, c
        assert (got[5000 + n : 5700] == 0).all() and (got[n:1000] == 0).all()
