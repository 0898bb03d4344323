"""Bootstrap intervals, classification and drift reports, and ledgers over result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lobwright.operators import acceptance as A
from lobwright.operators import evaluate as K
from lobwright.operators import fills as B
from lobwright.operators import ledger as J
from lobwright.operators import resample as H
from lobwright.operators import stress as G
from lobwright.operators.provenance import reads, split_names, transfer_protocol, with_origin
from lobwright.operators.splits import asset_pairs
from lobwright.operators.tune import POLICIES
from lobwright.plans.chain import scored, test_trades, tuned
from lobwright.plans.queries_execution import _EASY, _SPREAD, _STRESS, _spread, curves, easy_trades
from lobwright.plans.registry import query
from lobwright.sources.stages import cut, per_key, stage

# ---------------------------------------------------------------- daily PnL and bootstrap

_DAY = "strftime(make_timestamp(event_us), '%Y-%m-%d')"
_DAILY = {
    **_EASY,
    "daily": f"""select symbol, policy, {_DAY} as day, sum(gross_pnl) as gross_pnl, sum(net_pnl) as net_pnl,
                        sum(total_cost) as total_cost, count(*) as n_trades from easy_trades group by 1, 2, 3""",
    "days": """
      select *, row_number() over (partition by symbol order by day) - 1 as day_no, count(*) over (partition by symbol) as n
      from (select symbol, day, """
    + ", ".join(
        f"coalesce(sum(net_pnl) filter (where policy = '{p}'), 0e0) as net_{i}, "
        f"coalesce(sum(n_trades) filter (where policy = '{p}'), 0)::double as trades_{i}"
        for i, p in enumerate(POLICIES)
    )
    + " from daily group by 1, 2)",
    "draws": """
      select symbol, b, ('0x' || substr(md5('7:' || b::varchar || ':' || k::varchar), 1, 8))::ubigint % n as day_no
      from (select symbol, n, b, unnest(range(n)) as k
            from (select symbol, n, unnest(range(1000)) as b from (select distinct symbol, n from days)))""",
    "resampled": """
      select symbol, b, count(*) as n_days, """
    + ", ".join(f"sum({c}_{i}) as {c}_{i}" for i in range(3) for c in ("net", "trades"))
    + " from draws join days using (symbol, day_no) group by 1, 2",
}


def daily(spark, sf):
    return stage(spark, sf, "daily", lambda: H.daily_pnl(easy_trades(spark, sf), ["symbol", "policy"]))


@query("h1_daily_pnl", "symbol:s day:s " + " ".join(f"net_{i}:r5 trades_{i}:i" for i in range(3)), "select * from days", extra=_DAILY)
def _(spark, sf):
    """Every day any policy traded, with 0 for the policies that did not."""
    return H.daily_by_policy(daily(spark, sf), POLICIES, ["symbol"])


@query("h2_paired_day_bootstrap", "symbol:s mean_diff:r6 n_days:i ci_low:r6 ci_high:r6",
       """select symbol, any_value(m) as mean_diff, any_value(nd) as n_days, quantile_cont(d, 0.025) as ci_low, quantile_cont(d, 0.975) as ci_high
          from (select symbol, b, avg(d) as d from pair_draws join pair_days using (symbol, day_no) group by 1, 2)
          join (select symbol, avg(d) as m, count(*) as nd from pair_days group by 1) using (symbol) group by 1""",
       extra={**_DAILY,
              "pair_days": """
                select *, row_number() over (partition by symbol order by day) - 1 as day_no, count(*) over (partition by symbol) as n
                from (select symbol, day, coalesce(a.net_pnl, 0e0) - coalesce(b.net_pnl, 0e0) as d
                      from (select * from daily where policy = 'risk_gate') a
                      full join (select * from daily where policy = 'cost_aware_threshold') b using (symbol, day))""",
              "pair_draws": """
                select symbol, b, ('0x' || substr(md5('7:' || b::varchar || ':' || k::varchar), 1, 8))::ubigint % n as day_no
                from (select symbol, n, b, unnest(range(n)) as k
                      from (select symbol, n, unnest(range(1000)) as b from (select distinct symbol, n from pair_days)))"""})
def _(spark, sf):
    return H.paired_day_bootstrap(daily(spark, sf), "risk_gate", "cost_aware_threshold", ["symbol"])


def _ci_sql(kind: str, a: int, b: int | None) -> str:
    net = f"net_{a}" if b is None else f"net_{a} - net_{b}"

    def per(i: int) -> str:
        return f"(net_{i} / nullif(trades_{i}, 0))"

    each = per(a) if b is None else f"{per(a)} - {per(b)}"
    total = f"sum(net_{a})" if b is None else f"sum(net_{a}) - sum(net_{b})"
    per_total = f"sum(net_{a}) / nullif(sum(trades_{a}), 0)"
    if b is not None:
        per_total += f" - sum(net_{b}) / nullif(sum(trades_{b}), 0)"
    return f"""
      select *, '{kind}' as row_type, '{POLICIES[a]}' as policy, '{"" if b is None else POLICIES[b]}' as comparison_policy
      from (select symbol, quantile_cont({net}, 0.025) as net_ci_low, quantile_cont({net}, 0.975) as net_ci_high,
                   coalesce(quantile_cont({each}, 0.025), 0) as per_trade_ci_low,
                   coalesce(quantile_cont({each}, 0.975), 0) as per_trade_ci_high from resampled group by 1)
      join (select symbol, count(*) as n_days, {total} as net_total, coalesce({per_total}, 0) as net_per_trade from days group by 1) using (symbol)"""


_CI = "symbol:s row_type:s policy:s comparison_policy:s n_days:i net_total:r5 net_per_trade:r6 net_ci_low:r5 net_ci_high:r5 per_trade_ci_low:r6 per_trade_ci_high:r6"
_CI_POLICY = " union all by name ".join(_ci_sql("policy", i, None) for i in range(3))
_CI_DIFF = " union all by name ".join(_ci_sql("difference", 2, j) for j in (1, 0))


def intervals(spark, sf):
    return stage(spark, sf, "intervals", lambda: H.bootstrap_table(daily(spark, sf), POLICIES, ["symbol"]))


@query("h3_policy_intervals", _CI, _CI_POLICY, extra=_DAILY)
def _(spark, sf):
    return intervals(spark, sf).filter("row_type = 'policy'")


@query("h4_difference_intervals", _CI, _CI_DIFF, extra=_DAILY)
def _(spark, sf):
    return intervals(spark, sf).filter("row_type = 'difference'")


# ---------------------------------------------------------------- classification and calibration

@query("k1_confusion_matrix", "symbol:s label:s pred_label:s n:i",
       """select s.symbol, a.label, b.label as pred_label, count(t.label) as n
          from (select distinct symbol from scored) s, (select unnest(['DOWN', 'FLAT', 'UP']) as label) a,
               (select unnest(['DOWN', 'FLAT', 'UP']) as label) b
          left join (select * from scored where split = 'test') t on t.symbol = s.symbol and t.label = a.label and t.pred_label = b.label
          group by 1, 2, 3""")
def _(spark, sf):
    test = scored(spark, sf).filter("split = 'test'")
    return K.confusion_matrix(K.confusion_counts(test, ["symbol"]), ["symbol"])


def _metrics_sql(by: str, source: str) -> str:
    """Per-class precision and recall from unpivoted counts, then averages over three classes."""
    return f"""
      select {by}, max(n) as n_rows, sum(tp) / max(n) as accuracy, sum(f1) / 3 as macro_f1, sum(f1 * sup) / max(n) as weighted_f1,
             sum(rec) / 3 as balanced_accuracy,
             coalesce((sum(tp) * max(n) - sum(sup * pre)) / nullif(sqrt((max(n)::double * max(n) - sum(sup * sup)) * (max(n)::double * max(n) - sum(pre * pre))), 0), 0) as mcc
      from (select *, coalesce(tp / nullif(sup, 0), 0) as rec, coalesce(2 * tp / nullif(sup + pre, 0), 0) as f1
            from (select {by}, c, count(*)::double as n, count(*) filter (where label = c and pred_label = c)::double as tp,
                         count(*) filter (where label = c)::double as sup, count(*) filter (where pred_label = c)::double as pre
                  from {source}, (select unnest(['DOWN', 'FLAT', 'UP']) as c) group by {by}, c))
      group by {by}"""


_METRICS = "n_rows:i accuracy:r8 macro_f1:r8 weighted_f1:r8 balanced_accuracy:r8 mcc:r7"
_TEST = "(select * from scored where split = 'test')"


@query("k2_classification_metrics", "symbol:s regime:s is_total:b " + _METRICS,
       f"""select *, false as is_total from ({_metrics_sql('symbol, regime', _TEST)})
           union all by name select *, null as regime, true as is_total from ({_metrics_sql('symbol', _TEST)})""")
def _(spark, sf):
    return K.classification_by_regime(scored(spark, sf).filter("split = 'test'"), ["symbol"])


_CAL = """
  select symbol, sum(n) as n_rows, sum(b) / sum(n) as brier_score, sum(c) / sum(n) as mean_confidence, sum(h) / sum(n) as accuracy,
         sum(n / total * abs(h / n - c / n)) as ece
  from (select symbol, bin, count(*)::double as n, sum(conf) as c, sum(hit) as h, sum(brier) as b, any_value(total) as total
        from (select symbol, greatest(prob_down, prob_flat, prob_up) as conf,
                     least(floor(round(greatest(prob_down, prob_flat, prob_up) * 10, 9)), 9) as bin,
                     (prob_down - (label = 'DOWN')::int) ** 2 + (prob_flat - (label = 'FLAT')::int) ** 2
                       + (prob_up - (label = 'UP')::int) ** 2 as brier,
                     (label = pred_label)::int as hit, count(*) over (partition by symbol) as total
              from scored where split = 'test') group by 1, 2)
  group by 1"""


@query("k3_calibration", "symbol:s n_rows:i brier_score:r8 mean_confidence:r8 accuracy:r8 ece:r8", _CAL)
def _(spark, sf):
    return K.calibration(scored(spark, sf), ["symbol"])


def _drift_sql() -> str:
    special = {"top_of_book_depth": "bids[1].size + asks[1].size", "abs_future_ret_h": "abs(future_ret_h)"}
    return " union all ".join(
        f"""select symbol, split, '{f}' as feature, count(*) as n_rows, avg({special.get(f, f)}) as mean,
                   stddev_pop({special.get(f, f)}) as std, quantile_cont({special.get(f, f)}, 0.05) as p05,
                   quantile_cont({special.get(f, f)}, 0.25) as p25, quantile_cont({special.get(f, f)}, 0.5) as median,
                   quantile_cont({special.get(f, f)}, 0.75) as p75, quantile_cont({special.get(f, f)}, 0.95) as p95
            from scored group by 1, 2"""
        for f in K.DRIFT_FEATURES
    )


_DRIFT = {"drift": _drift_sql()}


def drift(spark, sf):
    return stage(spark, sf, "drift", lambda: K.distribution_stats(K.drift_frame(scored(spark, sf)), ["symbol", "split"]))


@query("k4_distribution_stats",
       "symbol:s split:s feature:s n_rows:i mean:r7 std:r7 p05:r7 p25:r7 median:r7 p75:r7 p95:r7", "select * from drift", extra=_DRIFT)
def _(spark, sf):
    return drift(spark, sf)


@query("k5_pair_ratios", "base_symbol:s other_symbol:s split:s feature:s mean_ratio:r6 median_ratio:r6",
       """select a.symbol as base_symbol, b.symbol as other_symbol, a.split, a.feature,
                 case when abs(a.mean) >= 1e-12 then b.mean / a.mean end as mean_ratio,
                 case when abs(a.median) >= 1e-12 then b.median / a.median end as median_ratio
          from drift a join drift b on a.split = b.split and a.feature = b.feature and a.symbol <> b.symbol""", extra=_DRIFT)
def _(spark, sf):
    return K.pair_ratios(drift(spark, sf), asset_pairs(scored(spark, sf)))


@query("k5b_transfer_drift", "train_symbol:s test_symbol:s feature:s mean_ratio:r6 median_ratio:r6",
       """select a.symbol as train_symbol, b.symbol as test_symbol, a.feature, case when abs(a.mean) >= 1e-12 then b.mean / a.mean end as mean_ratio,
                 case when abs(a.median) >= 1e-12 then b.median / a.median end as median_ratio
          from (select * from drift where split = 'train') a join (select * from drift where split = 'test') b
            on a.feature = b.feature and a.symbol <> b.symbol""", extra=_DRIFT)
def _(spark, sf):
    return K.transfer_drift(drift(spark, sf), asset_pairs(scored(spark, sf)))


@query("k6_label_balance", "scope:s symbol:s split:s label:s n_rows:i share:r8",
       """select 'within_asset' as scope, symbol, split, label, count(*) as n_rows,
                 count(*) / sum(count(*)) over (partition by symbol, split) as share from scored group by symbol, split, label""")
def _(spark, sf):
    return K.balance(scored(spark, sf), "label")


@query("k6b_regime_balance", "scope:s symbol:s split:s regime:s n_rows:i share:r8",
       """select 'within_asset' as scope, symbol, split, regime, count(*) as n_rows,
                 count(*) / sum(count(*)) over (partition by symbol, split) as share from scored group by symbol, split, regime""")
def _(spark, sf):
    return K.balance(scored(spark, sf), "regime")


def _direction_sql(value: str) -> str:
    return f"""
      select 'asset_heldout_target_test' as scope, a.symbol || '>' || t.symbol as direction, t.symbol, split, {value}, n_rows, share
      from (select symbol, split, {value}, count(*) as n_rows, count(*) / sum(count(*)) over (partition by symbol, split) as share
            from scored where split = 'test' group by symbol, split, {value}) t
      join (select distinct symbol from scored) a on a.symbol <> t.symbol"""


@query("k6c_label_balance_by_direction", "scope:s direction:s symbol:s split:s label:s n_rows:i share:r8", _direction_sql("label"))
def _(spark, sf):
    d = scored(spark, sf)
    return K.balance_by_direction(d, "label", asset_pairs(d))


@query("k6d_regime_balance_by_direction", "scope:s direction:s symbol:s split:s regime:s n_rows:i share:r8", _direction_sql("regime"))
def _(spark, sf):
    d = scored(spark, sf)
    return K.balance_by_direction(d, "regime", asset_pairs(d))


def _side_sql(split: str, prefix: str) -> str:
    return f"""
      select symbol, {", ".join(f"avg((label = '{c}')::int) as {prefix}_{c.lower()}_share" for c in K.LABELS)},
             avg((regime = 'UNKNOWN')::int) as {prefix}_unknown_share,
             (select regime from scored i where i.symbol = o.symbol and i.split = '{split}' and regime <> 'UNKNOWN'
              group by regime order by count(*) desc, regime limit 1) as {prefix}_top_regime
      from scored o where split = '{split}' group by symbol"""


@query("k7_transfer_table",
       "train_symbol:s test_symbol:s source_train_down_share:r8 source_train_flat_share:r8 source_train_up_share:r8 "
       "source_train_unknown_share:r8 source_train_top_regime:s target_test_up_share:r8 target_test_unknown_share:r8 "
       "target_test_top_regime:s ece:r8 brier_score:r8 cost_aware_threshold_net_pnl:r5 risk_gate_net_pnl:r5 gate_loss_reduction:r5",
       f"""select a.symbol as train_symbol, b.symbol as test_symbol, a.* exclude (symbol), b.* exclude (symbol), ece, brier_score,
                  c.net_pnl as cost_aware_threshold_net_pnl, g.net_pnl as risk_gate_net_pnl, g.net_pnl - c.net_pnl as gate_loss_reduction
           from ({_side_sql('train', 'source_train')}) a join ({_side_sql('test', 'target_test')}) b on a.symbol <> b.symbol
           left join ({_CAL}) k on k.symbol = b.symbol
           left join (select symbol, sum(net_pnl) as net_pnl from easy_trades where policy = 'cost_aware_threshold' group by 1) c on c.symbol = b.symbol
           left join (select symbol, sum(net_pnl) as net_pnl from easy_trades where policy = 'risk_gate' group by 1) g on g.symbol = b.symbol""",
       extra=_EASY)
def _(spark, sf):
    rows = scored(spark, sf)
    pnl = B.summarize(easy_trades(spark, sf), ["symbol", "policy"])
    return K.transfer_table(
        K.balance(rows, "label"), K.balance(rows, "regime"), K.calibration(rows, ["symbol"]), pnl, asset_pairs(rows)
    )


#: Bits of the rows that the tuning and the class means of each symbol read, computed from the rows themselves.
_BIT = "case split when 'train' then 1 when 'valid' then 2 when 'test' then 4 else 8 end"
_READS = {
    "tuning_reads": f"select symbol, bit_or({_BIT}) as tuned_bits from valid group by 1",
    "means_rows": "select * from scored where split = 'train'",
    "all_reads": f"select symbol, bit_or(bits) as read_bits from (select symbol, tuned_bits as bits from tuning_reads union all select symbol, {_BIT} from means_rows) group by 1",
}


@query("k8_source_only_protocol", "train_symbol:s test_symbol:s policy:s theta:r11 valid_rows:i target_test_rows:i source_reads:i target_reads:i status:s",
       """select a.symbol as train_symbol, b.symbol as test_symbol, a.policy, a.theta, v.n as valid_rows, b.n as target_test_rows,
                 r.read_bits as source_reads, 0 as target_reads, case when r.read_bits & 12 = 0 then 'PASS' else 'FAIL' end as status
          from winners a join (select symbol, count(*) as n from valid group by 1) v using (symbol) join all_reads r using (symbol)
          join (select symbol, count(*) as n from test group by 1) b on b.symbol <> a.symbol""", extra=_READS)
def _(spark, sf):
    """Thresholds come from the source's validation rows; the target's test rows are only counted.  The status is computed
    from the bits that tuning and fits carried along."""
    rows = scored(spark, sf)
    n = rows.groupBy("symbol").agg(F.expr("count_if(split = 'valid') as v"), F.expr("count_if(split = 'test') as t"))
    picked = tuned(spark, sf).filter("selected").selectExpr("symbol as train_symbol", "policy", "theta", "read_bits")
    chosen = cut(asset_pairs(rows).join(picked, "train_symbol"), "directions")
    read = chosen.selectExpr("train_symbol", "test_symbol", "train_symbol as _from", "read_bits as bits")
    status = transfer_protocol(read, chosen.select("train_symbol", "test_symbol").distinct())
    return (
        chosen.join(status, ["train_symbol", "test_symbol"])
        .join(n.selectExpr("symbol as train_symbol", "v as valid_rows"), "train_symbol")
        .join(n.selectExpr("symbol as test_symbol", "t as target_test_rows"), "test_symbol")
    )


@query("k8b_leaking_transfer", "train_symbol:s test_symbol:s mean_up:r11 source_reads:i target_reads:i other_reads:i status:s",
       f"""select t as train_symbol, u as test_symbol, coalesce(avg(future_ret_h) filter (where label = 'UP'), 0e0) as mean_up,
                  coalesce(bit_or({_BIT}) filter (where symbol = t), 0) as source_reads, coalesce(bit_or({_BIT}) filter (where symbol = u), 0) as target_reads,
                  0 as other_reads, case when max((symbol = u or split = 'test')::int) = 1 then 'FAIL' else 'PASS' end as status
           from (select a.symbol as t, b.symbol as u, s.* from (select distinct symbol from scored) a join (select distinct symbol from scored) b
                   on a.symbol <> b.symbol join scored s on s.symbol = a.symbol and s.split = 'train'
                 union all select 'click', 'view', s.* from scored s where symbol = 'view' and split = 'test')
           group by 1, 2""")
def _(spark, sf):
    """The class mean of every direction, where one direction's fit is deliberately given the target's test rows as well."""
    rows = with_origin(scored(spark, sf)).select("exchange", "symbol", "split", "label", "future_ret_h", "_from", "_bit")
    pairs = per_key(asset_pairs(rows))
    honest = rows.filter("split = 'train'").join(pairs, F.col("symbol") == F.col("train_symbol"))
    leak = rows.filter("symbol = 'view' and split = 'test'").join(
        pairs.filter("train_symbol = 'click' and test_symbol = 'view'"), F.col("symbol") == F.col("test_symbol")).withColumn("symbol", F.col("train_symbol"))
    used = cut(honest.unionByName(leak), "fitted_rows")
    means = used.groupBy("train_symbol", "test_symbol").agg(F.coalesce(F.avg(F.when(F.col("label") == "UP", F.col("future_ret_h"))), F.lit(0.0)).alias("mean_up"))
    return transfer_protocol(reads([used], ["train_symbol", "test_symbol"]), means)


# ---------------------------------------------------------------- ledgers

_MODEL = "case symbol when 'click' then 'sgd_' when 'view' then 'xgboost_' when 'error' then 'tcn_' when 'signup' then 'asset_sgd_' else 'plain_' end || symbol"


def _with_model(df):
    return df.withColumn("model", F.expr(_MODEL.replace("case", "concat(case", 1).replace(" || symbol", ", symbol)")))


_J = {
    **_DAILY,
    "pnl": """select symbol, policy, count(*) as n_trades, sum(gross_pnl) as gross_pnl, sum(net_pnl) as net_pnl
              from easy_trades group by 1, 2""",
    "quality": _metrics_sql("symbol", _TEST),
    "cis": _CI_DIFF,
}


def _pnl(spark, sf):
    return stage(spark, sf, "pnl", lambda: B.summarize(easy_trades(spark, sf), ["symbol", "policy"]))


def _quality(spark, sf):
    test = scored(spark, sf).filter("split = 'test'")
    return K.metrics_from_counts(K.confusion_counts(test, ["symbol"]), ["symbol"])


@query("j1_model_summary", "model:s quality_accuracy:r8 quality_mcc:r7 gate_net_pnl:r5 gate_n_trades:i ci_net_ci_low:r5 ci_net_ci_high:r5",
       f"""select {_MODEL} as model, accuracy as quality_accuracy, mcc as quality_mcc, g.net_pnl as gate_net_pnl, g.n_trades as gate_n_trades,
                  net_ci_low as ci_net_ci_low, net_ci_high as ci_net_ci_high
           from (select distinct symbol from scored) left join quality using (symbol)
           left join (select * from pnl where policy = 'risk_gate') g using (symbol)
           left join (select * from cis where comparison_policy = 'cost_aware_threshold') using (symbol)""", extra=_J)
def _(spark, sf):
    models = _with_model(scored(spark, sf).groupBy("symbol").agg(F.count("*").alias("n")).select("symbol"))
    diff = intervals(spark, sf).filter("row_type = 'difference' and comparison_policy = 'cost_aware_threshold'")
    return J.join_results(
        models,
        {"quality": _quality(spark, sf), "gate": _pnl(spark, sf).filter("policy = 'risk_gate'").drop("policy"), "ci": diff},
        ["symbol"],
    )


@query("j2_forecast_and_execution",
       "symbol:s accuracy:r8 " + " ".join(f"{p}_net_pnl:r5 {p}_n_trades:i" for p in POLICIES) + " loss_reduction:r5",
       "select symbol, accuracy, " + ", ".join(
           f"max(net_pnl) filter (where policy = '{p}') as {p}_net_pnl, max(n_trades) filter (where policy = '{p}') as {p}_n_trades" for p in POLICIES
       ) + """, max(net_pnl) filter (where policy = 'risk_gate') - max(net_pnl) filter (where policy = 'cost_aware_threshold') as loss_reduction
            from quality left join pnl using (symbol) group by 1, 2""", extra=_J)
def _(spark, sf):
    wide = J.policy_columns(_pnl(spark, sf), ["symbol"], POLICIES)
    out = _quality(spark, sf).join(wide, "symbol", "left")
    return out.withColumn("loss_reduction", F.col("risk_gate_net_pnl") - F.col("cost_aware_threshold_net_pnl"))


@query("j3_priority_union", "symbol:s policy:s net_pnl:r5 source:s sort_order:i",
       """select symbol, policy, net_pnl, source, case policy when 'risk_gate' then 1 when 'naive_threshold' then 2 else 3 end as sort_order
          from (select *, row_number() over (partition by symbol, policy order by r) as k
                from (select symbol, policy, sum(net_pnl) as net_pnl, 'tuned' as source, 0 as r from test_trades group by 1, 2
                      union all select symbol, policy, net_pnl, 'default', 1 from pnl)) where k = 1""", extra=_J)
def _(spark, sf):
    tuned_pnl = B.summarize(test_trades(spark, sf), ["symbol", "policy"]).withColumn("source", F.lit("tuned"))
    default = _pnl(spark, sf).withColumn("source", F.lit("default"))
    return J.in_order(J.first_of([tuned_pnl, default], ["symbol", "policy"]), "policy", ["risk_gate", "naive_threshold"])


@query("j4_upsert", "symbol:s policy:s net_pnl:r5 source:s",
       """select symbol, policy, net_pnl, 'default' as source from pnl p
          where not exists (select 1 from test_trades t where t.symbol = p.symbol and t.policy = p.policy)
          union all select symbol, policy, sum(net_pnl), 'tuned' from test_trades group by 1, 2""", extra=_J)
def _(spark, sf):
    fresh = B.summarize(test_trades(spark, sf), ["symbol", "policy"]).withColumn("source", F.lit("tuned"))
    return J.upsert(_pnl(spark, sf).withColumn("source", F.lit("default")), fresh, ["symbol", "policy"])


@query("j4b_comparison_merge", "model:s n_trades:i source:s",
       """select symbol as model, n_trades, source from (
            select *, row_number() over (partition by symbol order by r desc) as k from (
              select symbol, n_trades, 'baseline' as source, 0 as r from pnl where policy = 'naive_threshold'
              union all select symbol, n_trades, 'previous', 1 from pnl where policy = 'cost_aware_threshold' and symbol <> 'error'
              union all select symbol, n_trades, 'fresh', 2 from pnl where policy = 'risk_gate' and symbol = 'click')) where k = 1""", extra=_J)
def _(spark, sf):
    def part(policy, source, where="true"):
        return _pnl(spark, sf).filter(f"policy = '{policy}' and {where}").selectExpr("symbol as model", "n_trades", f"'{source}' as source")

    return J.comparison(
        part("naive_threshold", "baseline"), part("cost_aware_threshold", "previous", "symbol <> 'error'"),
        part("risk_gate", "fresh", "symbol = 'click'"),
    )


@query("j5_first_available", "symbol:s net_pnl:r5 source_no:i",
       """select s.symbol, coalesce(a.net_pnl, b.net_pnl) as net_pnl, case when a.symbol is not null then 0 when b.symbol is not null then 1 end as source_no
          from (select distinct symbol from scored) s
          left join (select * from pnl where policy = 'risk_gate' and net_pnl > 0) a on a.symbol = s.symbol
          left join (select * from pnl where policy = 'naive_threshold') b on b.symbol = s.symbol""", extra=_J)
def _(spark, sf):
    base = scored(spark, sf).groupBy("symbol").agg(F.count("*").alias("n")).select("symbol")
    p = _pnl(spark, sf)
    return J.first_available(
        base, [p.filter("policy = 'risk_gate' and round(net_pnl, 9) > 0"), p.filter("policy = 'naive_threshold'")], ["symbol"], ["net_pnl"]
    )


@query("j6_column_aliases", "model_label:s axis:s level:r2 net_pnl:r5",
       "select symbol as model_label, stress_axis as axis, stress_level as level, net_pnl from curves where policy = 'risk_gate'", extra=_STRESS)
def _(spark, sf):
    return J.canonical(
        curves(spark, sf).filter("policy = 'risk_gate'"),
        {"model_label": ("model_label", "model", "symbol"), "axis": ("axis", "stress_axis"), "level": ("level", "stress_level"), "net_pnl": ("net_pnl",)},
    )


@query("j7_selection_ledger",
       "symbol:s policy:s theta:r11 selection_source:s selection_audit_status:s validation_result:s test_n_trades:i test_net_pnl:r5",
       """select t.symbol, t.policy, t.theta, case tuned_bits when 2 then 'valid' else 'other' end as selection_source,
                 case when read_bits & 12 = 0 then 'PASS_VALIDATION_ONLY' else 'FAIL_TEST_SELECTION' end as selection_audit_status,
                 '{"net_pnl":' || round(net_pnl, 6)::decimal(20,6)::varchar || ',"n_trades":' || n_trades::varchar || ',"n_trade_days":'
                   || n_trade_days::varchar || ',"split":"valid"}' as validation_result, test_n_trades, test_net_pnl
          from tuned t left join (select symbol, policy, count(*) as test_n_trades, sum(net_pnl) as test_net_pnl from test_trades group by 1, 2) r
               using (symbol, policy) join tuning_reads using (symbol) join all_reads using (symbol) where selected""", extra=_READS)
def _(spark, sf):
    tuning = tuned(spark, sf).withColumn("split", split_names(F.col("tuned_bits")))
    results = B.summarize(test_trades(spark, sf), ["symbol", "policy"]).select("symbol", "policy", "n_trades", "net_pnl")
    return J.selection_ledger(tuning, results, ["symbol", "policy"])


@query("j8_candidate_counts", "symbol:s policy:s n_candidates:i n_selected:i selection_sources:s selected_thresholds:s selection_audit_status:s",
       """select symbol, policy, count(*) as n_candidates, count(*) filter (where selected) as n_selected,
                 case any_value(tuned_bits) when 2 then 'valid' else 'other' end as selection_sources,
                 string_agg(printf('%.9f', round(theta, 9)), ',') filter (where selected) as selected_thresholds,
                 case when any_value(read_bits) & 12 = 0 then 'PASS_VALIDATION_ONLY' else 'FAIL_TEST_SELECTION' end as selection_audit_status
          from tuned join tuning_reads using (symbol) join all_reads using (symbol) group by 1, 2""", extra=_READS)
def _(spark, sf):
    return J.candidate_counts(tuned(spark, sf), ["symbol", "policy"])


@query("j9_overfitting_readiness", "status:s n_candidate_groups:i n_threshold_candidates:i n_with_daily_returns:i",
       """select case when n_threshold_candidates = n_with_daily_returns and n_threshold_candidates > 0 then 'READY'
                      else 'INFEASIBLE_FROM_CURRENT_SAVED_ARTIFACTS' end as status, *
          from (select count(distinct symbol || '/' || policy) as n_candidate_groups, count(*) as n_threshold_candidates, count(days) as n_with_daily_returns
                from tuned t left join (select symbol, policy, theta, count(distinct event_us // 86400000000) as days from test_trades
                                        join winners using (symbol, policy) group by 1, 2, 3 having days >= 2) d using (symbol, policy, theta))""")
def _(spark, sf):
    """Only the selected thresholds have trades that were kept; whether that suffices is counted."""
    tuning = tuned(spark, sf)
    chosen = tuning.filter("selected").select("symbol", "policy", "theta")
    daily = test_trades(spark, sf).select("symbol", "policy", F.expr("event_us div 86400000000 as day")).join(chosen, ["symbol", "policy"])
    return J.overfitting_readiness(tuning.select("symbol", "policy", "theta"), daily)


@query("j10_model_family", "model:s family:s n_rows:i",
       f"""select model, case when model like 'asset_%' then 'asset_heldout_streaming_sgd' when model like '%xgboost%' then 'xgboost_gpu_tabular'
                  when model like '%tcn%' then 'temporal_tcn' when model like '%sgd%' then 'streaming_sgd_tabular' else 'unknown' end as family, n_rows
           from (select {_MODEL} as model, count(*) as n_rows from scored group by 1)""")
def _(spark, sf):
    models = _with_model(scored(spark, sf)).groupBy("model").agg(F.count("*").alias("n_rows"))
    return models.withColumn("family", J.model_family(F.col("model")))


@query("j11_final_selection", "symbol:s best_validation_policy:s test_best_policy:s test_net_pnl:r5 test_n_trades:i test_best_differs:b",
       """select v.symbol, v.policy as best_validation_policy, b.policy as test_best_policy, r.net_pnl as test_net_pnl, r.n_trades as test_n_trades,
                 coalesce(v.policy <> b.policy, false) as test_best_differs
          from (select symbol, policy from (select *, row_number() over (partition by symbol order by round(net_pnl, 9) desc, policy desc) as k
                from tuned where selected) where k = 1) v
          left join (select symbol, policy from (select *, row_number() over (partition by symbol order by round(net_pnl, 9) desc, policy desc) as k
                from test_pnl) where k = 1) b using (symbol)
          left join test_pnl r on r.symbol = v.symbol and r.policy = v.policy""",
       extra={"test_pnl": "select symbol, policy, count(*) as n_trades, sum(net_pnl) as net_pnl from test_trades group by 1, 2"})
def _(spark, sf):
    test = B.summarize(test_trades(spark, sf), ["symbol", "policy"])
    return J.final_selection(tuned(spark, sf).filter("selected"), test, ["symbol"])


# ---------------------------------------------------------------- acceptance bar

#: Each bar as (least spread, least axes, least resamples): the fixed ones, and ones that nothing meets.
_BARS = {"fixed": (A.LEAST_SPREAD, A.LEAST_AXES, A.LEAST_RESAMPLES), "beyond": (2.0, 99, 10**6)}
_CLAIMS = {"regimes_matter": ("regime_variation", "worst_regime", "regime_gap"), "costs_matter": ("edge_lost_to_costs", "stress_degradation", "stress_axes"),
           "gate_gains": ("interval_support",)}


def _bar_sql(bar: str, spread: float, axes: int, resamples: int) -> str:
    won = "case when count(*) filter (where comparable) = 0 then 'PARTIAL' when bool_or(comparable and {w}) then 'PASS' else '{e}' end"
    parts = {
        "regime_variation": f"""select symbol, case when count(*) >= 3 and round(max(macro_f1) - min(macro_f1), 9) >= {spread!r} then 'PASS' else 'PARTIAL' end as status,
                                count(*) as n, round(max(macro_f1) - min(macro_f1), 9) as figure from ({_metrics_sql('symbol, regime', _TEST)}) group by symbol""",
        "edge_lost_to_costs": """select symbol, case when bool_or(lost) then 'PASS' else 'PARTIAL' end as status, count(*) as n, count(*) filter (where lost)::double as figure
              from (select symbol, round(net, 9) < 0 and (not tuned or round(gross, 9) > 0) as lost
                    from (select symbol, policy, true as tuned, sum(gross_pnl) as gross, sum(net_pnl) as net from test_trades group by 1, 2
                          union all select symbol, policy, false, sum(gross_pnl), sum(net_pnl) from easy_trades group by 1, 2)) group by 1""",
        "stress_degradation": """select symbol, case when bool_or(degraded) then 'PASS' else 'PARTIAL' end as status, count(*) as n, count(*) filter (where degraded)::double as figure
              from (select symbol, policy, count(*) >= 2 and arg_max(net_pnl, stress_level) < arg_min(net_pnl, stress_level) as degraded
                    from curves where stress_axis = 'fee_bps' group by 1, 2) group by 1""",
        **{name: f"""select symbol, {won.format(w=w, e=e)} as status, count(*) filter (where comparable) as n, count(*) filter (where comparable and {w})::double as figure
                     from gate_compared group by 1""" for name, w, e in (("worst_regime", "better", "FAIL"), ("regime_gap", "closer", "PARTIAL"))},
        "stress_axes": f"""select symbol, case when count(distinct stress_axis) >= {axes} then 'PASS' else 'PARTIAL' end as status, count(*) as n,
                                  count(distinct stress_axis)::double as figure from curves group by 1""",
        "interval_support": f"""select symbol, case when not bool_and(n_days > 1) or 1000 < {resamples} then 'FAIL' when bool_and(round(net_ci_low, 9) > 0) then 'PASS' else 'PARTIAL' end
                                as status, count(*) as n, count(*) filter (where round(net_ci_low, 9) > 0)::double as figure from ({_CI_DIFF}) group by 1""",
    }
    found = " union all ".join(f"select '{k}' as criterion, symbol, status, n, figure from ({v})" for k, v in parts.items())
    names = ", ".join(f"('C{i + 1:02d}', '{c}')" for i, c in enumerate(A.CRITERIA))
    return f"""select '{bar}' as bar, g.symbol, c.criterion_id, c.criterion, coalesce(f.status, 'FAIL') as status, coalesce(f.n, 0) as n, coalesce(f.figure, 0) as figure
               from (select distinct symbol from scored) g cross join (values {names}) c(criterion_id, criterion)
               left join ({found}) f on f.symbol = g.symbol and f.criterion = c.criterion"""


_BAR_BLOCKS = {
    **_STRESS, **_DAILY,
    "gate_compared": f"""
      select symbol, gw is not null and bw is not null as comparable, coalesce(round(gw, 9) >= round(bw, 9), false) as better,
             coalesce(round(gg, 9) <= round(bg, 9), false) as closer
      from (select symbol, max(worst_regime_return) filter (where policy = 'risk_gate') as gw,
                   max(worst_regime_return) filter (where policy <> 'risk_gate') as bw,
                   min(regime_gap) filter (where policy = 'risk_gate') as gg, min(regime_gap) filter (where policy <> 'risk_gate') as bg
            from ({_SPREAD}) group by 1)""",
    "bars": " union all ".join(_bar_sql(name, *values) for name, values in _BARS.items()),
}


def _acceptance(spark, sf):
    rows, by = scored(spark, sf), ["symbol"]
    metrics = K.metrics_from_counts(K.confusion_counts(rows.filter("split = 'test'"), ["symbol", "regime"]), ["symbol", "regime"])
    shared = {
        "edge_lost_to_costs": A.edge_lost(B.summarize(test_trades(spark, sf), ["symbol", "policy"]), B.summarize(easy_trades(spark, sf), ["symbol", "policy"]), by),
        "stress_degradation": A.stress_degradation(G.degradation(curves(spark, sf).filter("stress_axis = 'fee_bps'"), ["symbol", "policy"]), by),
    }
    wins = cut(G.gate_wins(_spread(spark, sf), by), "gate_wins")
    shared["worst_regime"] = A.gate_status(wins, by, "wins_worst_regime", "FAIL")
    shared["regime_gap"] = A.gate_status(wins, by, "wins_regime_gap", "PARTIAL")
    differences = intervals(spark, sf).filter("row_type = 'difference'").selectExpr("symbol", "n_days", "1000 as n_resamples", "net_ci_low as low")
    out = None
    for name, (spread, axes, resamples) in _BARS.items():
        bar = A.acceptance_bar(rows, {
            **shared, "regime_variation": A.regime_variation(metrics, by, least_spread=spread), "stress_axes": A.stress_axes(curves(spark, sf), by, axes),
            "interval_support": A.interval_support(differences, by, resamples)}, by).withColumn("bar", F.lit(name))
        out = bar if out is None else out.unionByName(bar)
    return out


@query("g5c_acceptance_bar", "bar:s symbol:s criterion_id:s criterion:s status:s n:i figure:r6", "select * from bars", extra=_BAR_BLOCKS)
def _(spark, sf):
    """All criteria of every symbol against the fixed bars and against bars that nothing meets."""
    return _acceptance(spark, sf)


@query("j11b_claim_status", "bar:s symbol:s claim:s claim_status:s n_criteria:i n_passed:i",
       f"""select bar, symbol, claim, case when bool_or(status = 'FAIL') then 'NOT_SUPPORTED' when bool_or(status = 'PARTIAL') then 'PARTIALLY_SUPPORTED'
                  else 'SUPPORTED' end as claim_status, count(*) as n_criteria, count(*) filter (where status = 'PASS') as n_passed
           from bars join (values {", ".join(f"('{k}', '{c}')" for k, v in _CLAIMS.items() for c in v)}) v(claim, criterion) using (criterion) group by 1, 2, 3""",
       extra=_BAR_BLOCKS)
def _(spark, sf):
    return A.claim_status(_acceptance(spark, sf), _CLAIMS, ["bar", "symbol"])
