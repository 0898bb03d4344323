"""Scoring, decisions, fills, tuning and stress."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobwright.operators import decide as D
from lobwright.operators import fills as B
from lobwright.operators import score as M
from lobwright.operators import stress as G
from lobwright.operators import tune as T
from lobwright.plans import oracle as O
from lobwright.plans.chain import EXECUTION, decided, scored, split_rows, test_trades, tuned
from lobwright.plans.queries_features import _SEVEN, _VECTOR_SQL, small_chain
from lobwright.plans.registry import query
from lobwright.sources.stages import stage

ID = "symbol:s event_idx:i "

# ---------------------------------------------------------------- scoring

_STD = ("rel_spread", "total_depth_10", "ofi_5")


@query("m1_standardizer", ID + " ".join(f"{c}:r6" for c in _STD),
       "select s.symbol, event_idx, " + ", ".join(f"(s.{c} - m.{c}_m) / m.{c}_s as {c}" for c in _STD)
       + " from scored s join (select symbol, " + ", ".join(f"avg({c}) as {c}_m, stddev_samp({c}) as {c}_s" for c in _STD)
       + " from scored where split = 'train' group by 1) m using (symbol)")
def _(spark, sf):
    d = scored(spark, sf)
    return M.apply_standardizer(d, M.fit_standardizer(d, _STD), _STD)


_CELLS_SQL = f"select *, {_VECTOR_SQL} as v from scored"
_SCALER = {
    "cell_rows": _CELLS_SQL,
    "cell_fit": """select symbol, i, avg(v[i]::double) as m, sqrt(greatest(var_pop(v[i]::double), 1e-12)) as s
                   from (select symbol, v, unnest(range(1, 41)) as i from cell_rows where split = 'train') group by 1, 2""",
    "cell_scaled": """select symbol, event_idx, i, ((v[i]::double - m) / s)::float as z
                      from (select symbol, event_idx, v, unnest(range(1, 41)) as i from cell_rows) join cell_fit using (symbol, i)""",
}


@query("m1b_vector_scaler", ID + "n_cells:i first:r4 second:r4 last:r4 total:r2",
       """select symbol, event_idx, count(*) as n_cells, max(z) filter (where i = 1) as first, max(z) filter (where i = 2) as second,
                 max(z) filter (where i = 40) as last, sum(z::double) as total from cell_scaled group by 1, 2""", extra=_SCALER)
def _(spark, sf):
    """The 40 cells of every row's vector, scaled by what the train rows of its symbol say."""
    from lobwright.operators.features import level_vector

    d = scored(spark, sf)
    scaler = M.fit_vector_scaler(d, level_vector(10), 40)
    d = d.join(scaler, ["exchange", "symbol"]).withColumn("v", level_vector(10, "scaler"))
    return d.selectExpr("symbol", "event_idx", "size(v) as n_cells", "v[0] as first", "v[1] as second", "v[39] as last",
                        "aggregate(v, 0D, (s, x) -> s + x) as total")


@query("m2_class_weights", "symbol:s label:s n_rows:i class_weight:r8",
       """select symbol, label, count(*) as n_rows, sum(count(*)) over (partition by symbol) / (3e0 * count(*)) as class_weight
          from scored where split = 'train' group by 1, 2""")
def _(spark, sf):
    return M.class_weights(scored(spark, sf))


@query("m5_linear_scores", ID + "prob_down:r8 prob_flat:r8 prob_up:r8 pred_label:s", "select * from scored")
def _(spark, sf):
    return scored(spark, sf)


def linear_predict(matrix):
    """The fixed linear model on a numpy matrix whose columns are ``FIXED_WEIGHTS`` in order."""
    import numpy as np

    from lobwright.operators.score import FIXED_INTERCEPTS, FIXED_WEIGHTS

    logits = matrix @ np.array(list(FIXED_WEIGHTS.values())) + np.array(FIXED_INTERCEPTS)
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@query("m5a_python_model_scores", ID + "prob_down:r8 prob_flat:r8 prob_up:r8 pred_label:s",
       "select symbol, event_idx, prob_down, prob_flat, prob_up, pred_label from scored")
def _(spark, sf):
    """The same model as Python code on Arrow batches."""
    return M.score_with(scored(spark, sf), linear_predict, M.FIXED_WEIGHTS, ["symbol", "event_idx"])


def window_predict(cube):
    """Probabilities from the change of the first cell over the window."""
    import numpy as np

    move = (cube[:, -1, 1] - cube[:, 0, 1]).astype("float64")
    logits = np.stack([-move, np.zeros_like(move), move], axis=1)
    e = np.exp(logits)
    return e / e.sum(axis=1, keepdims=True)


@query("m5b_window_scores", ID + "split:s prob_down:r4 prob_flat:r4 prob_up:r4",
       """select symbol, event_idx, split, exp(-mv) / (exp(-mv) + 1 + exp(mv)) as prob_down, 1 / (exp(-mv) + 1 + exp(mv)) as prob_flat,
                 exp(mv) / (exp(-mv) + 1 + exp(mv)) as prob_up
          from (select *, (v - lag(v, 19) over w)::double as mv, row_number() over w - 1 as pos
                from (select *, strftime(make_timestamp(event_us), '%Y-%m-%d') as date, ln(1 + asks[1].size)::float as v from spl)
                window w as (partition by exchange, symbol, split, date order by event_idx))
          where pos >= 19 and (pos - 19) % 3 = 0""")
def _(spark, sf):
    from lobwright.plans.queries_features import _windows

    return M.score_windows(_windows(spark, sf, 3), window_predict, ["symbol", "event_idx", "split"])


# ---------------------------------------------------------------- decisions

@query("e1_expected_edge", ID + "estimated_edge:r10", "select * from decided")
def _(spark, sf):
    return decided(spark, sf)


@query("e2_naive_action", ID + "action:i", f"select symbol, event_idx, {O.naive('6e-1')} as action from decided")
def _(spark, sf):
    return decided(spark, sf).withColumn("action", D.naive_action(F.lit(0.6)))


@query("e3_cost_aware_action", ID + "action:i",
       f"select symbol, event_idx, {O.beyond('estimated_edge', '(estimated_cost + 1e-5)')} as action from decided")
def _(spark, sf):
    return decided(spark, sf).withColumn("action", D.cost_action(F.lit(1e-5)))


@query("e4_risk_gate",
       ID + "action:i required_edge:r8 estimated_cost:r10 latency_risk:r10 liquidity_risk:r5 adverse_risk:r5 regime_risk:r4",
       f"select *, {O.required()} as required_edge, {O.beyond('estimated_edge', O.required())} as action from decided")
def _(spark, sf):
    return decided(spark, sf).withColumns({"required_edge": D.required_edge(), "action": D.gate_action()})


_VARIANT_SQL = {
    "full": O.required(),
    "no-latency-risk": O.required(lat="0e0"),
    "no-liquidity-risk": O.required(liq="0e0"),
    "no-adverse-risk": O.required(adv="0e0"),
    "no-regime-penalty": O.required(reg="0e0"),
    "no-cost-gate": f"({O.required()} - 1e0)",
}


@query("e5_gate_ablations", "symbol:s variant:s action:i n_rows:i",
       "select symbol, variant, action, count(*) as n_rows from ("
       + " union all ".join(
           f"select symbol, '{v}' as variant, {O.beyond('estimated_edge', need)} as action from decided" for v, need in _VARIANT_SQL.items()
       ) + ") where action <> 0 group by 1, 2, 3")
def _(spark, sf):
    """All variants in one scan: each row lists the variants under which it trades."""
    acts = F.array(
        *[
            F.struct(F.lit(v).alias("variant"), D.gate_action(cfg).alias("action"))
            for v, cfg in D.gate_variants(no_cost_gate=True).items()
        ]
    )
    rows = decided(spark, sf).select("symbol", F.explode(F.filter(acts, lambda a: a["action"] != 0)).alias("a"))
    return rows.select("symbol", "a.*").groupBy("symbol", "variant", "action").agg(F.count("*").alias("n_rows"))


@query("e6_imbalance_action", ID + "action:i",
       """select symbol, event_idx, case when depth_imbalance_10 > 2e-1 then 1 when depth_imbalance_10 < -2e-1 then -1 else 0 end as action
          from scored""")
def _(spark, sf):
    return scored(spark, sf).withColumn("action", D.imbalance_action(0.2))


# The reduced chain: probabilities of a fixed model on its own features.
_SMALL_W = {"momentum_score": (6000.0, 0.0, -6000.0), "depth_imbalance_10": (-1.5, 0.1, 1.5), "spread_z_100": (0.1, 0.3, 0.1)}


def _small_logit(k: int) -> str:
    return " + ".join([f"{M.FIXED_INTERCEPTS[k]}::double"] + [f"{w[k]}::double * {f}" for f, w in _SMALL_W.items()])


_SMALL_ORACLE = {
    **_SEVEN,
    "small_scored": f"""
      select *, exp(l0) / (exp(l0) + exp(l1) + exp(l2)) as prob_down, exp(l1) / (exp(l0) + exp(l1) + exp(l2)) as prob_flat,
             exp(l2) / (exp(l0) + exp(l1) + exp(l2)) as prob_up
      from (select *, {_small_logit(0)} as l0, {_small_logit(1)} as l1, {_small_logit(2)} as l2 from seven)""",
    "small_means": """
      select exchange, symbol, avg(future_ret_h) filter (where label = 'DOWN') as md, avg(future_ret_h) filter (where label = 'FLAT') as mf,
             avg(future_ret_h) filter (where label = 'UP') as mu from small_scored where split = 'train' group by 1, 2""",
    "small_gate": """
      select *, case when edge > need then edge - need when edge < -need then edge + need else 0e0 end as gate_score
      from (select *, prob_up * mu + prob_down * md + prob_flat * mf as edge,
                   cost_threshold_t + (25e-2 * abs(realized_vol_20) + 25e-2 * rel_spread
                     + 15e-2 * (case when regime in ('LIQUIDITY_DROUGHT', 'VOLATILE_ILLIQUID') then 1e0 else 0e0 end) * rel_spread) as need
            from small_scored join small_means using (exchange, symbol))""",
}


def small_scored(spark, sf) -> DataFrame:
    from lobwright.operators.labels import class_return_means

    def build():
        rows = M.score_linear(small_chain(spark, sf), _SMALL_W)
        return D.with_expected_edge(rows, class_return_means(rows)).withColumn("gate_score", D.small_gate_score())

    return stage(spark, sf, "small_scored", build)


@query("e7_small_gate_score", ID + "gate_score:r9", "select * from small_gate", extra=_SMALL_ORACLE)
def _(spark, sf):
    return small_scored(spark, sf)


_SMALL_NAIVE = """case when round(prob_up, 12) >= 45e-2 and round(prob_up, 12) >= round(prob_down, 12) then 1
                      when round(prob_down, 12) >= 45e-2 then -1 else 0 end"""


@query("e8_small_naive_action", ID + "action:i", f"select symbol, event_idx, {_SMALL_NAIVE} as action from small_gate",
       extra=_SMALL_ORACLE)
def _(spark, sf):
    return small_scored(spark, sf).withColumn("action", D.small_naive_action())


# ---------------------------------------------------------------- fills

_ALL_LEGS = {
    "legs": """select exchange, symbol, event_idx as row_at, side, 15e-1 as sm, 5e-1 as dm,
                      event_idx * 10 + (side + 1) + 1000000 * dense_rank() over (order by symbol) as leg_id
               from book, (select unnest([1, -1]) as side)""",
    "priced": "select *, (bids[1].price + asks[1].price) / 2e0 as mid_price from book",
    "swept": O.fills("legs", "priced", 20000.0),
}


@query("b1_depth_sweep", ID + "side:i price:r6 quantity:r7 fill_ratio:r8 slippage:r6",
       "select symbol, row_at as event_idx, side, s.* exclude (leg_id) from legs l join swept s using (leg_id)", extra=_ALL_LEGS)
def _(spark, sf):
    """Both sides of every snapshot, with a wider spread and half the depth, for a size several levels deep."""
    from lobwright.plans.chain import indexed_book

    rows = indexed_book(spark, sf).selectExpr(
        "symbol", "event_idx", "bids", "asks", "(bids[0].price + asks[0].price) / 2D as mid_price", "explode(array(1, -1)) as side"
    )
    fill = B.sweep("side", 20000.0, "1.5D", "0.5D")
    return rows.withColumn("f", fill).selectExpr("symbol", "event_idx", "side", "f.*")


_TRIP = (
    "symbol:s policy:s signal_index:i entry_index:i exit_index:i event_us:i regime:s action:i quantity:r7 entry_price:r6 "
    "exit_price:r6 gross_pnl:r6 fill_ratio:r7 entry_slippage:r6 exit_slippage:r6"
)
_EASY = {
    "easy_grid": f"""select exchange, symbol, policy, theta from (select distinct exchange, symbol from test),
                     (values ('naive_threshold', 5e-1), ('cost_aware_threshold', 0e0), ('risk_gate', 0e0)) v(policy, theta)""",
    "easy_signals": "select *, 1 as latency, 1e0 as sm, 1e0 as dm from (" + O.grid_signals("test", "easy_grid") + ")",
    **O.trips("z", "easy_signals", "test", "s.policy"),
    "easy_thin": O.thinned("z_trips", "exchange, symbol, policy", 3),
    "easy_trades": O.charged("easy_thin"),
}


def easy_grid(test) -> DataFrame:
    """Low thresholds for all three policies, so that there are many signals."""
    return test.groupBy("exchange", "symbol").agg(F.lit(1).alias("one")).selectExpr(
        "exchange", "symbol",
        "inline(array(struct('naive_threshold' as policy, 0.5D as theta), struct('cost_aware_threshold' as policy, 0D as theta), "
        "struct('risk_gate' as policy, 0D as theta)))",
    )


def easy_signals(spark, sf) -> DataFrame:
    test = split_rows(spark, sf, "test")
    return T.grid_signals(test, easy_grid(test))


def easy_replay(spark, sf) -> DataFrame:
    test = split_rows(spark, sf, "test")
    return T.winner_trades(test, easy_grid(test), EXECUTION)


def easy_trades(spark, sf) -> DataFrame:
    return stage(spark, sf, "easy_trades", lambda: easy_replay(spark, sf))


@query("b2_round_trips", _TRIP, "select * from z_trips", extra=_EASY)
def _(spark, sf):
    signals = T.by_member(easy_signals(spark, sf))
    return B.round_trips(signals, split_rows(spark, sf, "test"), EXECUTION, by=("policy",))


@query("b3_cooldown", _TRIP + " total_cost:r6 net_pnl:r6", "select * from easy_trades", extra=_EASY)
def _(spark, sf):
    return easy_replay(spark, sf)


_SMALL_TRADES = {
    **_SMALL_ORACLE,
    "small_test": "select * from small_gate where split = 'test'",
    "small_signals": f"""select *, 1 as latency, 1e0 as sm, 1e0 as dm from (
        select exchange, symbol, 'naive' as policy, event_idx, {_SMALL_NAIVE} as action from small_test union all
        select exchange, symbol, 'gate', event_idx, sign(gate_score)::int from small_test) where action <> 0""",
    **O.trips("y", "small_signals", "small_test", "s.policy", hold=20, last_row=True),
    "small_thin": O.thinned("y_trips", "exchange, symbol, policy", 11),
    "small_trades": O.charged("small_thin"),
}


@query("b4_small_replay", "symbol:s policy:s signal_index:i entry_index:i action:i quantity:r7 gross_pnl:r6 net_pnl:r6",
       "select * from small_trades", extra=_SMALL_TRADES)
def _(spark, sf):
    """The replay variant: waits after the signal, may exit on the last row."""
    test = small_scored(spark, sf).filter("split = 'test'")
    acts = F.array(
        F.struct(F.lit("naive").alias("policy"), D.small_naive_action().alias("action")),
        F.struct(F.lit("gate").alias("policy"), F.signum("gate_score").cast("tinyint").alias("action")),
    )
    signals = test.select("exchange", "symbol", "event_idx", F.explode(acts).alias("a")).select(
        "exchange", "symbol", "event_idx", "a.*"
    ).filter("action <> 0")
    cfg = replace(EXECUTION, hold=20, cooldown=10, cooldown_on="signal", last_row=True)
    return B.replay(signals, test, cfg, by=("policy",))


_SUMMARY = (
    "symbol:s policy:s n_trades:i gross_pnl:r5 net_pnl:r5 total_cost:r5 turnover:r5 turnover_notional:r3 net_pnl_per_trade:r6 "
    "max_drawdown:r5 cost_survival:r4"
)


@query("b5_trade_summary", _SUMMARY, O.summary("easy_trades", "symbol, policy"), extra=_EASY)
def _(spark, sf):
    return B.summarize(easy_trades(spark, sf), ["symbol", "policy"])


@query("f13_equity_curve", "symbol:s policy:s entry_index:i equity:r5 equity_peak:r5",
       """select *, max(equity) over (partition by symbol, policy order by entry_index) as equity_peak
          from (select *, sum(net_pnl) over (partition by symbol, policy order by entry_index) as equity from easy_trades)""",
       extra=_EASY)
def _(spark, sf):
    return B.equity_curve(easy_trades(spark, sf), ["symbol", "policy"])


@query("b6_by_regime", "symbol:s policy:s regime:s is_total:b gross_pnl:r5 net_pnl:r5 n_trades:i",
       """select symbol, policy, regime, grouping(regime) = 1 as is_total, sum(gross_pnl) as gross_pnl, sum(net_pnl) as net_pnl,
                 count(*) as n_trades from easy_trades group by grouping sets ((symbol, policy, regime), (symbol, policy))""",
       extra=_EASY)
def _(spark, sf):
    return B.summarize_by_regime(easy_trades(spark, sf), ["symbol", "policy"])


@query("b7_trade_days", "symbol:s policy:s n_trade_days:i",
       "select symbol, policy, count(distinct event_us // 86400000000) as n_trade_days from easy_trades group by 1, 2", extra=_EASY)
def _(spark, sf):
    return B.trade_days(easy_trades(spark, sf), ["symbol", "policy"])


@query("b8_worst_trades", "symbol:s policy:s entry_index:i net_pnl:r6 regime:s",
       "select * from easy_trades order by round(net_pnl, 9), symbol, policy, entry_index limit 25", extra=_EASY)
def _(spark, sf):
    return B.worst_trades(easy_trades(spark, sf), 25, ("symbol", "policy", "entry_index"))


# ---------------------------------------------------------------- tuning

@query("t1_naive_grid", "symbol:s theta:r2 n_signals:i",
       """select symbol, theta, count(*) filter (where action <> 0) as n_signals
          from (select d.symbol, g.theta, """ + O.naive("g.theta") + """ as action from valid d join valid_grid g using (exchange, symbol)
                where g.policy = 'naive_threshold') group by 1, 2""")
def _(spark, sf):
    """Each threshold with the number of validation rows that trade under it."""
    valid = split_rows(spark, sf, "valid")
    grid = T.naive_grid(valid)
    acting = T.by_member(T.grid_signals(valid, grid.withColumn("policy", F.lit("naive_threshold"))))
    n = acting.groupBy("symbol", "theta").agg(F.count("*").alias("n"))
    return grid.join(n, ["symbol", "theta"], "left").selectExpr("symbol", "theta", "coalesce(n, 0L) as n_signals")


@query("t2_margin_grid", "symbol:s policy:s theta:r11", "select * from valid_grid where policy <> 'naive_threshold'")
def _(spark, sf):
    return T.policy_grid(split_rows(spark, sf, "valid")).filter("policy <> 'naive_threshold'")


@query("t3_policy_tuning", "symbol:s policy:s theta:r11 n_trades:i gross_pnl:r5 net_pnl:r5 n_trade_days:i eligible:b selected:b",
       "select * from tuned")
def _(spark, sf):
    return tuned(spark, sf)


@query("t3b_low_bar_tuning", "symbol:s policy:s theta:r11 n_trades:i gross_pnl:r5 net_pnl:r5 n_trade_days:i eligible:b selected:b",
       """select *, row_number() over (partition by exchange, symbol, policy order by eligible desc, round(net_pnl, 9) desc, theta) = 1 as selected
          from (select *, n_trades >= 20 and n_trade_days >= 2 as eligible from tried)""")
def _(spark, sf):
    """The same trials under a bar low enough that thresholds on both sides of it meet."""
    tried = tuned(spark, sf).drop("eligible", "selected")
    return T.select_threshold(tried, split_rows(spark, sf, "valid"), min_trades=20, min_days=2)


@query("t4_tuning_record",
       "symbol:s policy:s theta:r11 lambda_latency:r2 lambda_liquidity:r2 lambda_adverse:r2 lambda_regime:r2 validation_objective:s",
       """select symbol, policy, theta, 0.25 as lambda_latency, 0.25 as lambda_liquidity, 0.25 as lambda_adverse, 0.15 as lambda_regime,
                 'max_net_pnl_with_min_trades_and_min_trade_days' as validation_objective from tuned where selected""")
def _(spark, sf):
    return T.tuning_record(tuned(spark, sf))


@query("t5_selected_on_test", "symbol:s policy:s theta:r11 n_trades:i net_pnl:r5 gross_pnl:r5",
       """select w.symbol, w.policy, w.theta, coalesce(n_trades, 0) as n_trades, coalesce(net_pnl, 0) as net_pnl,
                 coalesce(gross_pnl, 0) as gross_pnl
          from winners w left join (select symbol, policy, count(*) as n_trades, sum(net_pnl) as net_pnl, sum(gross_pnl) as gross_pnl
                                    from test_trades group by 1, 2) using (symbol, policy)""")
def _(spark, sf):
    winners = T.winner_grid(tuned(spark, sf)).select("symbol", "policy", "theta")
    return B.fill_missing_groups(B.summarize(test_trades(spark, sf), ["symbol", "policy"]), winners, ["symbol", "policy"])


@query("t6_systematic_sample", ID + "split:s",
       """select symbol, event_idx, split from (select *, event_idx - min(event_idx) over (partition by symbol) as k,
                 greatest(ceil(count(*) over (partition by symbol) / 100), 1) as step from scored where split = 'valid')
          where k % step = 0""")
def _(spark, sf):
    return T.systematic_sample(scored(spark, sf).filter("split = 'valid'"), 100)


@query("t7_hash_sample", ID + "regime:s",
       "select * from scored where ('0x' || substr(md5('11:' || sequence_number::varchar), 1, 8))::ubigint / 4294967296e0 <= 1e-1")
def _(spark, sf):
    return T.hash_sample(scored(spark, sf), F.col("sequence_number"), 0.1, seed=11)


# ---------------------------------------------------------------- stress

_CASES = [
    (i, axis, float(level), cfg) for i, (axis, level, cfg) in enumerate(G.scenarios(EXECUTION))
]
_STRESS = {
    **_EASY,
    "cases": "select * from (values "
    + ", ".join(
        f"({i}, '{a}', {lv}::double, {c.fee_bps}::double, {c.latency}, {c.spread_multiplier}::double, {c.depth_multiplier}::double)"
        for i, a, lv, c in _CASES
    )
    + ") v(scenario, stress_axis, stress_level, fee_bps, latency, sm, dm)",
    "stress_signals": """select s.exchange, s.symbol, s.policy, s.event_idx, s.action, c.* from easy_signals s join cases c on true""".replace(
        "c.*", "c.scenario, c.stress_axis, c.stress_level, c.fee_bps, c.latency, c.sm, c.dm"
    ),
    **O.trips("x", "stress_signals", "test", "s.policy, s.scenario, s.stress_axis, s.stress_level, s.fee_bps"),
    "stress_thin": O.thinned("x_trips", "exchange, symbol, policy, scenario", 3),
    "stress_trades": O.charged("stress_thin", "fee_bps"),
    "curves": O.summary("stress_trades", "symbol, policy, stress_axis, stress_level"),
}


def curves(spark, sf) -> DataFrame:
    """Stage: the summary of every stress cell."""
    return stage(spark, sf, "curves", lambda: G.stress_summary(
        G.stress_trades(easy_signals(spark, sf), split_rows(spark, sf, "test"), EXECUTION)))


@query("g1_stress_grid",
       "symbol:s policy:s stress_axis:s stress_level:r2 n_trades:i gross_pnl:r5 net_pnl:r5 total_cost:r5 max_drawdown:r5",
       "select * from curves", extra=_STRESS)
def _(spark, sf):
    return curves(spark, sf)


@query("g2_robustness_auc", "symbol:s policy:s stress_axis:s robustness_auc:r5",
       """select symbol, policy, stress_axis, case when max(stress_level) > min(stress_level)
                 then sum((net_pnl + y) / 2 * (stress_level - x)) / (max(stress_level) - min(stress_level)) end as robustness_auc
          from (select *, lag(stress_level) over w as x, lag(net_pnl) over w as y from curves
                window w as (partition by symbol, policy, stress_axis order by stress_level)) group by 1, 2, 3""", extra=_STRESS)
def _(spark, sf):
    return G.robustness_auc(curves(spark, sf), ["symbol", "policy", "stress_axis"])


@query("g3_latency_half_life", "symbol:s policy:s latency_half_life:r2",
       """select symbol, policy, min(case when base > 0 and net_pnl <= 5e-1 * base then stress_level end) as latency_half_life
          from (select *, first_value(net_pnl) over (partition by symbol, policy order by stress_level) as base from curves
                where stress_axis = 'latency_events') group by 1, 2""", extra=_STRESS)
def _(spark, sf):
    return G.latency_half_life(curves(spark, sf).filter("stress_axis = 'latency_events'"), ["symbol", "policy"])


_SPREAD = """select symbol, policy, min(net_pnl) as worst_regime_return, max(net_pnl) - min(net_pnl) as regime_gap,
                    avg(net_pnl) as mean_regime_return
             from (select symbol, policy, regime, sum(net_pnl) as net_pnl from easy_trades group by 1, 2, 3) group by 1, 2"""


def _spread(spark, sf):
    by_regime = B.summarize_by_regime(easy_trades(spark, sf), ["symbol", "policy"]).filter("not is_total")
    return G.regime_spread(by_regime, ["symbol", "policy"])


@query("g4_regime_spread", "symbol:s policy:s worst_regime_return:r5 regime_gap:r5 mean_regime_return:r5", _SPREAD, extra=_EASY)
def _(spark, sf):
    return _spread(spark, sf)


@query("g5_gate_wins", "symbol:s comparable:b wins_worst_regime:b wins_regime_gap:b",
       f"""select symbol, gw is not null and bw is not null as comparable, coalesce(round(gw, 9) >= round(bw, 9), false) as wins_worst_regime,
                  coalesce(round(gg, 9) <= round(bg, 9), false) as wins_regime_gap
           from (select symbol, max(worst_regime_return) filter (where policy = 'risk_gate') as gw,
                        max(worst_regime_return) filter (where policy <> 'risk_gate') as bw,
                        min(regime_gap) filter (where policy = 'risk_gate') as gg,
                        min(regime_gap) filter (where policy <> 'risk_gate') as bg from ({_SPREAD}) group by 1)""", extra=_EASY)
def _(spark, sf):
    return G.gate_wins(_spread(spark, sf), ["symbol"])


@query("g5b_fee_degradation", "symbol:s policy:s n_levels:i degraded:b",
       """select symbol, policy, count(*) as n_levels, count(*) >= 2 and arg_max(net_pnl, stress_level) < arg_min(net_pnl, stress_level)
                 as degraded from curves where stress_axis = 'fee_bps' group by 1, 2""", extra=_STRESS)
def _(spark, sf):
    return G.degradation(curves(spark, sf).filter("stress_axis = 'fee_bps'"), ["symbol", "policy"])


