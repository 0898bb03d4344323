import random
from dataclasses import replace

import pandas as pd
import pytest
from helpers import book, signals

from lobwright.operators import fills as B
from lobwright.operators.thin import thin

CFG = B.Execution(latency=0, hold=1, notional=500.0, fee_bps=10.0, cooldown=0)


def sweep(spark, side, sm=1.0, dm=1.0, notional=500.0, partial=True, **kw):
    row = book(spark, 1, **kw).withColumn("f", B.sweep(str(side), notional, f"{sm}D", f"{dm}D", partial)).select("f.*").first()
    return row


def test_buy_and_sell_walk_levels(spark):
    r = sweep(spark, 1, asks={0: [(101.0, 3.0), (102.0, 10.0)]})
    assert (r.quantity, r.fill_ratio) == (5.0, 1.0) and r.price == pytest.approx(101.4) and r.slippage == pytest.approx(0.4)
    r = sweep(spark, -1, bids={0: [(99.0, 3.0), (98.0, 10.0)]})
    assert r.quantity == 5.0 and r.price == pytest.approx(98.6) and r.slippage == pytest.approx(0.4)


def test_spread_and_depth_multipliers(spark):
    asks = {0: [(101.0, 3.0), (102.0, 4.0)] + [(None, 1.0)] * 18}
    assert sweep(spark, 1, sm=2.0, asks=asks).price == pytest.approx(102.8)
    r = sweep(spark, 1, dm=0.5, asks=asks)
    assert r.quantity == pytest.approx(3.5) and r.fill_ratio == pytest.approx(0.7)


def test_missing_level_is_skipped(spark):
    asks = {0: [(101.0, 3.0), (None, 4.0), (103.0, 10.0)]}
    assert sweep(spark, 1, asks=asks).price == pytest.approx((3 * 101 + 2 * 103) / 5)


def test_invalid_top_of_book_fills_nothing(spark):
    assert sweep(spark, 1, asks={0: [(98.0, 3.0)]}).fill_ratio == 0.0
    assert sweep(spark, 1, asks={0: [(101.0, 0.0)]}).fill_ratio == 0.0


def trips(spark, cfg=CFG, idx=(0,), action=1, n=8, **kw):
    return B.replay(signals(spark, idx, action), book(spark, n, **kw), cfg).orderBy("signal_index").toPandas()


def test_long_and_short_round_trip(spark):
    asks = {0: [(101.0, 3.0), (102.0, 10.0)]}
    t = trips(spark, asks=asks, bids={1: [(103.0, 3.0), (102.0, 10.0)]} , mid=lambda i: 100.0,
              )
    assert t.empty  # bid 103 above ask 101 is a crossed row
    t = trips(spark, asks={**asks, 1: [(104.0, 10.0)]}, bids={1: [(103.0, 3.0), (102.0, 10.0)]})
    assert t.entry_price[0] == pytest.approx(101.4) and t.exit_price[0] == pytest.approx(102.6)
    assert t.gross_pnl[0] == pytest.approx(6.0) and t.total_cost[0] == pytest.approx(1.02) and t.net_pnl[0] == pytest.approx(4.98)
    t = trips(spark, action=-1, bids={0: [(99.0, 3.0), (98.0, 10.0)], 1: [(96.0, 1.0)]}, asks={1: [(97.0, 3.0), (98.0, 10.0)]})
    assert t.gross_pnl[0] == pytest.approx(6.0) and t.total_cost[0] == pytest.approx(0.98) and t.net_pnl[0] == pytest.approx(5.02)


def test_partial_exit(spark):
    thin_exit = {1: [(103.0, 3.0)] + [(None, None)] * 19}
    asks = {0: [(101.0, 10.0)], 1: [(104.0, 10.0)]}
    t = trips(spark, asks=asks, bids=thin_exit)
    assert t.quantity[0] == pytest.approx(3.0) and t.fill_ratio[0] == pytest.approx(0.6)
    assert trips(spark, replace(CFG, min_fill_ratio=0.7), asks=asks, bids=thin_exit).empty
    assert trips(spark, replace(CFG, partial_fill=False), asks=asks, bids=thin_exit).empty


def test_latency_hold_and_last_row(spark):
    t = trips(spark, replace(CFG, latency=2))
    assert (t.entry_index[0], t.exit_index[0]) == (2, 3)
    assert list(trips(spark, idx=range(8)).signal_index) == list(range(6))  # the last row is never an exit
    assert list(trips(spark, replace(CFG, last_row=True), idx=range(8)).signal_index) == list(range(7))


def test_cooldown(spark):
    assert list(trips(spark, replace(CFG, cooldown=3), idx=(0, 1, 4)).signal_index) == [0, 4]
    # a signal that cannot fill blocks nothing
    dead = {0: [(98.0, 3.0)]}
    assert list(trips(spark, replace(CFG, cooldown=3), idx=(0, 1, 4), asks=dead).signal_index) == [1, 4]


def greedy(idx, gap):
    out, last = [], -(10**12)
    for i in sorted(idx):
        if i - last >= gap:
            out.append(i)
            last = i
    return out


@pytest.mark.parametrize("gap", [1, 2, 3, 7, 40])
def test_thinning_equals_sequential_rule(spark, gap):
    rnd = random.Random(gap)
    rows, want = [], {}
    for key in range(12):
        density = rnd.choice([0.02, 0.3, 0.9, 1.0])
        idx = [i for i in range(2000) if rnd.random() < density] or [5]
        want[key] = greedy(idx, gap)
        rows += [(key, i, i * 0.5) for i in idx]
    df = spark.createDataFrame(rows, "k int, i long, payload double")
    got = thin(df, ["k"], "i", gap, block_rows=16, group_blocks=4).toPandas()
    assert (got.payload == got.i * 0.5).all()
    assert {k: sorted(g.i) for k, g in got.groupby("k")} == want


def test_summary_and_drawdown_across_blocks(spark):
    rnd = random.Random(3)
    rows = [("p", i * 3, i * 3_600_000_000, 1.0, 100.0, rnd.uniform(-2, 2), 0.1) for i in range(400)]
    t = pd.DataFrame(rows, columns=["policy", "entry_index", "event_us", "quantity", "entry_price", "gross_pnl", "total_cost"])
    t["net_pnl"] = t.gross_pnl - t.total_cost
    df = spark.createDataFrame(t)
    got = B.summarize(df, ["policy"], block_rows=50).first()
    equity = t.net_pnl.cumsum()
    assert got.n_trades == 400 and got.net_pnl == pytest.approx(t.net_pnl.sum())
    assert got.max_drawdown == pytest.approx((equity - equity.cummax()).min())
    assert got.n_trade_days == 17
    curve = B.equity_curve(df, ["policy"], block_rows=50).orderBy("entry_index").toPandas()
    assert curve.equity.to_numpy() == pytest.approx(equity.to_numpy())
    assert curve.equity_peak.to_numpy() == pytest.approx(equity.cummax().to_numpy())


def test_fee_and_depth_stress_hurt(spark):
    base = trips(spark, idx=range(6))
    dear = trips(spark, replace(CFG, fee_bps=50.0), idx=range(6))
    assert dear.net_pnl.sum() < base.net_pnl.sum()
