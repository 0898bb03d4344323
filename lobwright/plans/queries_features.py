"""Per-row features, sequence features, labels, regimes and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lobwright.operators import regimes as R
from lobwright.operators import splits as S
from lobwright.operators.chunks import ChunkSql, drop_halo, with_halo
from lobwright.operators.features import (
    CORE_COLUMNS,
    LOOK_BACK,
    compact,
    depth_features,
    distance_features,
    level_vector,
    level_windows,
    order_flow,
    price_features,
    return_features,
    sequence_features,
    small_feature_set,
    tensor_columns,
    with_group_position,
)
from lobwright.operators.labels import add_labels, class_return_means
from lobwright.plans import oracle as O
from lobwright.plans.chain import indexed_book, labelled, regimed, scored
from lobwright.plans.registry import query
from lobwright.sources.book import QUOTE_COLUMNS
from lobwright.sources.stages import cut

ID = "symbol:s event_idx:i "


def _priced(spark, sf):
    return price_features(indexed_book(spark, sf))


@query("p1_mid_spread", ID + "mid_price:r6 spread:r6 rel_spread:r10", "select * from rowf")
def _(spark, sf):
    return _priced(spark, sf)


@query("p2_microprice", ID + "microprice:r6 microprice_deviation:r10", "select * from rowf")
def _(spark, sf):
    return _priced(spark, sf)


_DEPTH = " ".join(
    f"bid_depth_{k}:r4 ask_depth_{k}:r4 total_depth_{k}:r4 depth_imbalance_{k}:r8 depth_ratio_{k}:r6 "
    + (f"book_slope_bid_{k}:r4 book_slope_ask_{k}:r4" if k > 1 else "")
    for k in (1, 3, 5, 10, 20)
)


@query("p3_depth", ID + _DEPTH, "select * from rowf")
def _(spark, sf):
    return depth_features(_priced(spark, sf))


@query("p3b_top_slope", ID + "book_slope_bid_1:r-3 book_slope_ask_1:r-3", "select * from rowf")
def _(spark, sf):
    """At one level the slope's denominator is only the guard term, so values are of the order 10^9."""
    return depth_features(_priced(spark, sf), (1,))


_DIST = "list_transform({s}s, lambda l: {d} / (mid_price + 1e-9))"
_DIST_BID = _DIST.format(s="bid", d="(bids[1].price - l.price)")
_DIST_ASK = _DIST.format(s="ask", d="(l.price - asks[1].price)")


@query("p4_level_distance", ID + "bid_0:r10 bid_7:r10 bid_19:r10 ask_0:r10 ask_7:r10 ask_19:r10 n_levels:i total:r8",
       f"""select *, b[1] as bid_0, b[8] as bid_7, b[20] as bid_19, a[1] as ask_0, a[8] as ask_7, a[20] as ask_19,
                  len(b) + len(a) as n_levels, list_sum(b) + list_sum(a) as total
           from (select symbol, event_idx, {_DIST_BID} as b, {_DIST_ASK} as a from rowf)""")
def _(spark, sf):
    d = distance_features(depth_features(_priced(spark, sf), (1, 20)))
    b, a = "bid_price_distance", "ask_price_distance"
    return d.selectExpr(
        "symbol", "event_idx", *[f"{b}[{i}] as bid_{i}" for i in (0, 7, 19)], *[f"{a}[{i}] as ask_{i}" for i in (0, 7, 19)],
        f"size({b}) + size({a}) as n_levels",
        f"aggregate({b}, 0D, (s, x) -> s + x) + aggregate({a}, 0D, (s, x) -> s + x) as total",
    )


@query("p5_weighted_distance", ID + "bid_depth_weighted_distance:r10 ask_depth_weighted_distance:r10",
       f"""select symbol, event_idx,
                  list_sum(list_transform(range(1, 21), lambda i: b[i] * bids[i].size)) / (bid_depth_20 + 1e-9) as bid_depth_weighted_distance,
                  list_sum(list_transform(range(1, 21), lambda i: a[i] * asks[i].size)) / (ask_depth_20 + 1e-9) as ask_depth_weighted_distance
           from (select *, {_DIST_BID} as b, {_DIST_ASK} as a from rowf)""")
def _(spark, sf):
    return distance_features(depth_features(_priced(spark, sf), (1, 20)))


@query("p6_top_share", ID + "top_depth_share_bid:r8 top_depth_share_ask:r8",
       """select symbol, event_idx, bid_depth_1 / (bid_depth_20 + 1e-9) as top_depth_share_bid,
                 ask_depth_1 / (ask_depth_20 + 1e-9) as top_depth_share_ask from rowf""")
def _(spark, sf):
    return distance_features(depth_features(_priced(spark, sf), (1, 20)))


@query("p7_tensor_columns", ID + "ask_price_0:r10 bid_price_19:r10 ask_size_5:r8 bid_size_0:r8 price_sum:r8 size_sum:r6",
       """select symbol, event_idx, pa[1] as ask_price_0, pb[20] as bid_price_19, sa[6] as ask_size_5, sb[1] as bid_size_0,
                 list_sum(pa) + list_sum(pb) as price_sum, list_sum(sa) + list_sum(sb) as size_sum
          from (select symbol, event_idx, list_transform(asks, lambda l: (l.price - mid_price) / (mid_price + 1e-9)) as pa,
                       list_transform(bids, lambda l: (l.price - mid_price) / (mid_price + 1e-9)) as pb,
                       list_transform(asks, lambda l: ln(1 + greatest(l.size, 0))) as sa,
                       list_transform(bids, lambda l: ln(1 + greatest(l.size, 0))) as sb from rowf)""")
def _(spark, sf):
    d = tensor_columns(_priced(spark, sf))
    total = "aggregate({0}, 0D, (s, x) -> s + x)"
    return d.selectExpr(
        "symbol", "event_idx", "ask_price_norm[0] as ask_price_0", "bid_price_norm[19] as bid_price_19",
        "ask_size_log1p[5] as ask_size_5", "bid_size_log1p[0] as bid_size_0",
        f"{total.format('ask_price_norm')} + {total.format('bid_price_norm')} as price_sum",
        f"{total.format('ask_size_log1p')} + {total.format('bid_size_log1p')} as size_sum",
    )


_VECTOR_SQL = """list_transform(flatten(list_transform(range(1, 11), lambda i: [
    (asks[i].price - mid_price) / mid_price, ln(1 + asks[i].size), (bids[i].price - mid_price) / mid_price,
    ln(1 + bids[i].size)])), lambda x: x::float)"""


@query("p8_level_vector", ID + "n_cells:i first:r6 second:r5 last:r5 total:r3",
       f"""select symbol, event_idx, len(v) as n_cells, v[1] as first, v[2] as second, v[40] as last, list_sum(v)::double as total
           from (select *, {_VECTOR_SQL} as v from rowf)""")
def _(spark, sf):
    d = _priced(spark, sf).withColumn("v", level_vector(10))
    return d.selectExpr(
        "symbol", "event_idx", "size(v) as n_cells", "v[0] as first", "v[1] as second", "v[39] as last",
        "aggregate(v, 0D, (s, x) -> s + x) as total",
    )


@query("p9_compact_columns", ID + "n_columns:i label:s mid_price:r6 ofi_5:r4",
       f"select symbol, event_idx, {len(CORE_COLUMNS) - 2} as n_columns, label, mid_price, ofi_5 from lab")
def _(spark, sf):
    d = compact(labelled(spark, sf))
    core = [c for c in d.columns if c in CORE_COLUMNS]
    return d.withColumn("n_columns", F.lit(len(core)))


@query("p10_execution_contract", ID + "split:s regime:s prob_up:r8 mid_price:r6 n_levels:i",
       "select symbol, event_idx, split, regime, prob_up, mid_price, len(bids) + len(asks) as n_levels from scored")
def _(spark, sf):
    from lobwright.operators.clean import require_columns

    needed = ("event_time", "mid_price", "spread", "rel_spread", "regime", "label", "future_ret_h", "prob_down", "prob_flat",
              "prob_up", "split", "bids", "asks", "label_fee_bps", "label_horizon_events")
    d = require_columns(scored(spark, sf), needed, "execution rows")
    return d.selectExpr("*", "size(bids) + size(asks) as n_levels")


_SMALL = {
    "small_r": f"""
      select *, coalesce(mid_price / lag(mid_price) over ({O.W}) - 1e0, 0e0) as ret_1,
             coalesce(mid_price / lag(mid_price, 10) over ({O.W}) - 1e0, 0e0) as ret_10 from small_f""",
    "small_f": O.row_features("book", "1e-12", (1, 5, 10, 20)),
    "small": f"""
      select *, coalesce({O.rows(20, 'stddev_samp(ret_1)')}, 0e0) as realized_vol_20,
             coalesce({O.rows(100, 'stddev_samp(ret_1)')}, 0e0) as realized_vol_100,
             {O.z('rel_spread', 100, 5, '1e-12')} as spread_z_100, {O.z('total_depth_10', 100, 5, '1e-12')} as depth_z_100,
             case when {O.rows(20, 'count(*)')} >= 2 then {O.rows(20, 'avg(ret_10)')} else 0e0 end as momentum_score from small_r""",
}


@query("p11_small_feature_set",
       ID + "ret_1:r10 ret_10:r10 realized_vol_20:r10 realized_vol_100:r10 spread_z_100:r5 depth_z_100:r5 momentum_score:r10",
       "select * from small", extra=_SMALL)
def _(spark, sf):
    return small_feature_set(indexed_book(spark, sf))


# ---------------------------------------------------------------- sequence features

@query("f1_order_flow", ID + "ofi_level_1:r4 ofi_level_10:r4 ofi_1:r4 ofi_5:r4 ofi_10:r4",
       "select *, terms[1] as ofi_level_1, terms[10] as ofi_level_10 from flow")
def _(spark, sf):
    win = ChunkSql()
    return drop_halo(order_flow(with_halo(indexed_book(spark, sf), back=1), win))


def _returns(spark, sf):
    win = ChunkSql()
    d = _priced(spark, sf).drop("bids", "asks")
    return drop_halo(return_features(with_halo(d, back=LOOK_BACK), win))


_RET = {"ret": O.returns("rowf")}


@query("f2_returns", ID + " ".join(f"mid_return_{k}:r10 log_return_{k}:r10" for k in (10, 50, 100)) + " one_step:r10",
       "select * from ret", extra=_RET)
def _(spark, sf):
    return _returns(spark, sf)


@query("f3_realized_vol", ID + " ".join(f"realized_vol_{n}:r10" for n in (20, 100, 500)), "select * from ret", extra=_RET)
def _(spark, sf):
    return _returns(spark, sf)


@query("f4_abs_return", ID + " ".join(f"abs_return_{n}:r9" for n in (20, 100, 500)), "select * from ret", extra=_RET)
def _(spark, sf):
    return _returns(spark, sf)


@query("f5_autocorrelation", ID + " ".join(f"return_autocorr_{n}:r6" for n in (20, 100, 500)), "select * from ret", extra=_RET)
def _(spark, sf):
    return _returns(spark, sf)


@query("f6_flip_rate", ID + " ".join(f"up_down_flip_rate_{n}:r7" for n in (20, 100, 500)), "select * from ret", extra=_RET)
def _(spark, sf):
    return _returns(spark, sf)


def _sequence(spark, sf, names: str):
    columns = tuple(c.split(":")[0] for c in (ID + names).split())
    return sequence_features(distance_features(depth_features(_priced(spark, sf))), columns=columns)


_Z = "vol_score:r5 spread_z_1m:r5 depth_z_1m:r5 ofi_proxy_score:r5 momentum_score:r5 adverse_selection_score:r5"


@query("f7_rolling_z", ID + _Z, "select * from inputs")
def _(spark, sf):
    return _sequence(spark, sf, _Z)


_INPUTS = (
    "imbalance_score:r8 depth_drop_top10:r7 top_level_depletion_flag:b spread_widening_flag:b liquidity_drought_score:r5 "
    "choppiness_score:r7 latency_sensitivity_score:r10"
)


@query("f8_regime_inputs", ID + _INPUTS, "select * from inputs")
def _(spark, sf):
    return _sequence(spark, sf, _INPUTS)


_WIN_SQL = f"""
  select symbol, split, date, event_idx, len(vecs) as window_rows, vecs[1][1] as first_cell, vecs[20][40] as last_cell, label
  from (select *, row_number() over w - 1 as pos, list(v) over (w rows between 19 preceding and current row) as vecs
        from (select *, strftime(make_timestamp(event_us), '%Y-%m-%d') as date, {_VECTOR_SQL} as v from spl)
        window w as (partition by exchange, symbol, split, date order by event_idx))
  where len(vecs) = 20 and (pos - 19) % 3 = 0"""


def _windows(spark, sf, stride):
    rows = scored(spark, sf).withColumn("date", F.expr("date_format(event_time, 'yyyy-MM-dd')"))
    return level_windows(with_group_position(rows), level_vector(10), 20, stride)


@query("f9_level_windows", "symbol:s split:s date:s event_idx:i window_rows:i first_cell:r6 last_cell:r5 label:s", _WIN_SQL)
def _(spark, sf):
    return _windows(spark, sf, 3).selectExpr(
        "symbol", "split", "date", "event_idx", "size(window) as window_rows", "window[0][0] as first_cell",
        "window[19][39] as last_cell", "label")


@query("f10_windows_per_split", "symbol:s split:s n_windows:i",
       f"select symbol, split, count(*) as n_windows from ({_WIN_SQL.replace('% 3', '% 1')}) group by 1, 2")
def _(spark, sf):
    return _windows(spark, sf, 1).groupBy("symbol", "split").agg(F.count("*").alias("n_windows"))


_RUNS_SQL = """
  select symbol, regime, count(*) as run_length, min(event_idx) as first_idx
  from (select *, sum(new) over (partition by symbol order by event_idx) as g
        from (select *, case when regime = lag(regime) over (partition by symbol order by event_idx) then 0 else 1 end as new from reg))
  group by symbol, g, regime"""


@query("f12_run_lengths", "symbol:s regime:s n_runs:i mean_run_length:r6 p50_run_length:r4 p90_run_length:r4 p99_run_length:r4 max_run_length:i",
       f"""select symbol, regime, count(*) as n_runs, avg(run_length) as mean_run_length,
                  quantile_cont(run_length, 0.5) as p50_run_length, quantile_cont(run_length, 0.9) as p90_run_length,
                  quantile_cont(run_length, 0.99) as p99_run_length, max(run_length) as max_run_length
           from ({_RUNS_SQL}) group by 1, 2""")
def _(spark, sf):
    return R.run_length_summary(regimed(spark, sf))


@query("f12b_runs", "symbol:s regime:s first_idx:i run_length:i", _RUNS_SQL)
def _(spark, sf):
    return R.run_lengths(regimed(spark, sf))


@query("f14_share_within_group", "symbol:s label:s n_rows:i total:i share:r8",
       """select symbol, label, count(*) as n_rows, sum(count(*)) over (partition by symbol) as total,
                 count(*) / sum(count(*)) over (partition by symbol) as share from lab group by 1, 2""")
def _(spark, sf):
    counts = labelled(spark, sf).groupBy("symbol", "label").agg(F.count("*").alias("n_rows"))
    return R.share_within(counts, ["symbol"], total="total", share="share")


# ---------------------------------------------------------------- labels, regimes, splits

@query("l1_labels", ID + "future_ret_h:r10 cost_threshold_t:r10 label:s label_horizon_events:i label_fee_bps:r2",
       "select * from l", extra={"l": O.labels("rowf")})
def _(spark, sf):
    return add_labels(_priced(spark, sf).drop("bids", "asks"))


@query("l1b_labels_reset_windows", ID + "future_ret_h:r10 label:s",
       "select * from l", extra={"l": O.labels("rowf")
              .replace("as future_mid from", f"as future_mid, lead(event_us, 50) over ({O.W}) as later from")
              .replace("future_mid is not null", "later // 864000000000 = event_us // 864000000000")})
def _(spark, sf):
    return add_labels(_priced(spark, sf).drop("bids", "asks"), reset_every_us=10 * 86_400_000_000)


@query("l2_class_return_means", "symbol:s mean_down:r10 mean_flat:r10 mean_up:r10", "select * from means")
def _(spark, sf):
    return class_return_means(scored(spark, sf))


@query("l3_features_and_labels",
       ID + "label:s rel_spread:r10 depth_imbalance_10:r8 ofi_5:r4 realized_vol_100:r10 vol_score:r5 momentum_score:r5 future_ret_h:r10",
       "select * from lab")
def _(spark, sf):
    return labelled(spark, sf)


@query("r1_taxonomy_scores", ID + "liquidity_score:r5 stress_score:r5 directional_toxicity_score:r5", "select * from scr")
def _(spark, sf):
    return R.taxonomy_scores(labelled(spark, sf))


@query("r2_thresholds", "symbol:s " + " ".join(f"{n}:r6" for n in R.THRESHOLDS), "select * from thr")
def _(spark, sf):
    return R.fit_thresholds(labelled(spark, sf))


@query("r2b_counted_thresholds", "symbol:s " + " ".join(f"{n}:r6" for n in R.THRESHOLDS), "select * from thr")
def _(spark, sf):
    """The same thresholds by counting prefixes, the way of groups too large for one task."""
    return R.fit_thresholds(labelled(spark, sf), exact_rows=0)


@query("r3_regimes", ID + "regime:s", "select * from reg")
def _(spark, sf):
    return regimed(spark, sf)


_SEVEN = {
    **_SMALL,
    "seven_lab": O.labels("small"),
    "seven_split": O.split("seven_lab"),
    "seven_q": """
      select exchange, symbol, quantile_cont(rel_spread, 0.7) as sh, quantile_cont(total_depth_10, 0.3) as dl,
             quantile_cont(total_depth_10, 0.7) as dh, quantile_cont(realized_vol_20, 0.7) as vh,
             quantile_cont(realized_vol_20, 0.4) as vl, quantile_cont(abs(momentum_score), 0.8) as mh
      from seven_split where split = 'train' group by 1, 2""",
    "seven": """
      select *, case when not (drought or volatile or calm or moving or liquid) then 'UNKNOWN'
             when moving and not drought then 'MOMENTUM_TOXIC' when calm and liquid then 'CALM_LIQUID'
             when volatile and not liquid then 'VOLATILE_ILLIQUID' when volatile and liquid then 'VOLATILE_LIQUID'
             when drought then 'LIQUIDITY_DROUGHT' else 'BALANCED_TRANSITION' end as regime
      from (select *, round(rel_spread, 9) >= round(sh, 9) and round(total_depth_10, 9) <= round(dl, 9) as drought,
                   round(realized_vol_20, 9) >= round(vh, 9) as volatile, round(total_depth_10, 9) >= round(dh, 9) as liquid,
                   round(realized_vol_20, 9) <= round(vl, 9) as calm, round(abs(momentum_score), 9) >= round(mh, 9) as moving
            from seven_split join seven_q using (exchange, symbol))""",
}


_SMALL_COLUMNS = (
    "exchange", "symbol", "event_us", "event_idx", "split", "label", "mid_price", "rel_spread", "depth_imbalance_10", "total_depth_10",
    "realized_vol_20", "realized_vol_100", "momentum_score", "spread_z_100", "depth_z_100", "future_ret_h", "cost_threshold_t",
    "label_horizon_events", "label_fee_bps", *QUOTE_COLUMNS,
)


def small_chain(spark, sf):
    """Reduced features, labels, split and the seven regimes."""
    d = add_labels(small_feature_set(indexed_book(spark, sf)))
    return R.seven_regimes(cut(S.chronological_split(d).select(*_SMALL_COLUMNS), "small"))


@query("r4_seven_regimes", ID + "split:s regime:s", "select * from seven", extra=_SEVEN)
def _(spark, sf):
    return small_chain(spark, sf)


@query("r5_regime_counts_by_month", "symbol:s month:s regime:s n_rows:i",
       "select symbol, strftime(make_timestamp(event_us), '%Y-%m') as month, regime, count(*) as n_rows from reg group by 1, 2, 3")
def _(spark, sf):
    return R.regime_counts_by_month(regimed(spark, sf))


@query("r5b_regime_share", "symbol:s regime:s n_rows:i share:r8",
       """select symbol, regime, count(*) as n_rows, count(*) / sum(count(*)) over (partition by symbol) as share
          from reg group by 1, 2""")
def _(spark, sf):
    return R.regime_share(regimed(spark, sf))


_UNK = """select symbol, strftime(make_timestamp(event_us), '{f}') as period,
                 avg(case when regime = 'UNKNOWN' then 1e0 else 0e0 end) as unknown_share from reg group by 1, 2"""


@query("r5c_unknown_share_by_day", "symbol:s period:s unknown_share:r8", _UNK.format(f="%Y-%m-%d"))
def _(spark, sf):
    return R.unknown_share(regimed(spark, sf), "day")


@query("r5d_unknown_share_by_month", "symbol:s period:s unknown_share:r8", _UNK.format(f="%Y-%m"))
def _(spark, sf):
    return R.unknown_share(regimed(spark, sf), "month")


@query("r5e_regime_medians", "symbol:s regime:s " + " ".join(f"{c}:r5" for c in R.MEDIAN_COLUMNS),
       f"select symbol, regime, {', '.join(f'quantile_cont({c}, 0.5) as {c}' for c in R.MEDIAN_COLUMNS)} from reg group by 1, 2")
def _(spark, sf):
    return R.regime_medians(regimed(spark, sf))


_NAMES = [*R.RULES, R.UNKNOWN]


@query("r6_month_share_pivot", "symbol:s month:s " + " ".join(f"{n}:r8" for n in _NAMES),
       "select symbol, strftime(make_timestamp(event_us), '%Y-%m') as month, "
       + ", ".join(f"count(*) filter (where regime = '{n}') / count(*) as {n}" for n in _NAMES) + " from reg group by 1, 2")
def _(spark, sf):
    return R.month_share_pivot(regimed(spark, sf))


@query("r6a_dominant_regime_by_day", "symbol:s date:s regime:s n_rows:i",
       """select symbol, date, regime, n_rows from (
            select *, row_number() over (partition by symbol, date order by n_rows desc, regime) as r
            from (select symbol, strftime(make_timestamp(event_us), '%Y-%m-%d') as date, regime, count(*) as n_rows
                  from reg group by 1, 2, 3)) where r = 1""")
def _(spark, sf):
    return R.dominant_regime_by_day(regimed(spark, sf))


@query("r6b_transition_sample", ID + "liquidity_score:r5 stress_score:r5 regime:s",
       "select * from reg where ('0x' || substr(md5('7:' || event_us::varchar), 1, 8))::ubigint / 4294967296e0 <= 2e-1")
def _(spark, sf):
    from lobwright.operators.tune import hash_sample

    return hash_sample(regimed(spark, sf), F.col("event_us"), 0.2)


@query("r7_regime_counts_by_split", "symbol:s split:s regime:s n_rows:i split_total_rows:i share_within_split:r8",
       """select symbol, split, regime, count(*) as n_rows, sum(count(*)) over (partition by symbol, split) as split_total_rows,
                 count(*) / sum(count(*)) over (partition by symbol, split) as share_within_split from spl group by 1, 2, 3""")
def _(spark, sf):
    return R.counts_by_split(scored(spark, sf))


@query("r8_regime_audit", "symbol:s n_rows:i unknown_rows:i unknown_share:r8 daily_unknown_p90:r8 n_days:i status:s",
       """select *, unknown_rows / n_rows as unknown_share, case when unknown_rows / n_rows < 0.15 then 'PASS' else 'REVIEW' end as status
          from (select symbol, sum(n) as n_rows, sum(u) as unknown_rows, quantile_cont(u / n, 0.9) as daily_unknown_p90,
                       count(*) as n_days
                from (select symbol, event_us // 86400000000 as d, count(*) as n, count(*) filter (where regime = 'UNKNOWN') as u
                      from reg group by 1, 2) group by 1)""")
def _(spark, sf):
    return R.audit_regimes(regimed(spark, sf))


_SENS = {f"thr_{s}": O.thresholds("scr", s) for s in R.SETTINGS}
_SENS["sens"] = (
    "select s.symbol, " + ", ".join(f"{O.cascade(f't{i}')} as {s}" for i, s in enumerate(R.SETTINGS)) + " from scr s "
    + " ".join(f"join thr_{s} t{i} on t{i}.exchange = s.exchange and t{i}.symbol = s.symbol" for i, s in enumerate(R.SETTINGS))
)
_SENS["sens_long"] = " union all ".join(
    f"select symbol, '{s}' as setting, {s} as regime, baseline from sens" for s in R.SETTINGS
)


@query("r9_quantile_sensitivity",
       "symbol:s setting:s regime:s n_rows:i share:r8 unknown_share:r8 agreement_with_baseline:r8",
       """select a.*, n_rows / total as share, unknown_share, agreement_with_baseline
          from (select symbol, setting, regime, count(*) as n_rows from sens_long group by 1, 2, 3) a
          join (select symbol, setting, count(*) as total, avg(case when regime = 'UNKNOWN' then 1e0 else 0e0 end) as unknown_share,
                       avg(case when regime = baseline then 1e0 else 0e0 end) as agreement_with_baseline
                from sens_long group by 1, 2) using (symbol, setting)""", extra=_SENS)
def _(spark, sf):
    return R.sensitivity(labelled(spark, sf))


@query("r11_taxonomy_table", "regime:s priority:i rule:s n_rows:i",
       "select u.regime, u.priority, u.rule, count(r.regime) as n_rows from (values "
       + ", ".join(f"('{n}', {i}, '{t}')" for i, (n, t) in enumerate(R.taxonomy_table(), 1))
       + ") u(regime, priority, rule) left join reg r on r.regime = u.regime group by 1, 2, 3")
def _(spark, sf):
    """The rule table with the number of rows each rule claims."""
    rows = ", ".join(f"struct('{n}' as regime, {i} as priority, '{t}' as rule)" for i, (n, t) in enumerate(R.taxonomy_table(), 1))
    counts = regimed(spark, sf).groupBy("regime").agg(F.count("*").alias("n"))
    table = counts.agg(F.max("n")).selectExpr(f"explode(array({rows})) as r").selectExpr("r.*")
    return table.join(counts, "regime", "left").selectExpr("regime", "priority", "rule", "coalesce(n, 0L) as n_rows")


@query("d1_chronological_split", ID + "split:s", "select * from spl")
def _(spark, sf):
    return S.chronological_split(regimed(spark, sf))


@query("d2_resplit", "symbol:s split:s n_rows:i first_idx:i last_idx:i n_prediction_columns:i",
       """select symbol, split, count(*) as n_rows, min(event_idx) as first_idx, max(event_idx) as last_idx,
                 0 as n_prediction_columns from again group by 1, 2""",
       extra={"reindexed": f"select * exclude (event_idx, split), row_number() over ({O.W}) - 1 as event_idx from scored",
              "again": O.split("reindexed", 0.5, 0.3, 20)})
def _(spark, sf):
    from lobwright.operators.index import event_index

    d = S.resplit(event_index(scored(spark, sf).drop("event_idx", "bids", "asks")), 0.5, 0.3, 20)
    n = len([c for c in S.PREDICTION_COLUMNS if c in d.columns])
    return d.groupBy("symbol", "split").agg(
        F.count("*").alias("n_rows"), F.min("event_idx").alias("first_idx"), F.max("event_idx").alias("last_idx")
    ).withColumn("n_prediction_columns", F.lit(n))


@query("d2b_checked_resplit", "symbol:s split:s n_rows:i first_idx:i last_idx:i n_reaching:i",
       """select symbol, split, count(*) as n_rows, min(event_idx) as first_idx, max(event_idx) as last_idx, 0 as n_reaching from again group by 1, 2""",
       extra={"reindexed": f"select * exclude (event_idx, split), row_number() over ({O.W}) - 1 as event_idx from scored",
              "again": O.split("reindexed", 0.5, 0.3, 60)})
def _(spark, sf):
    """Written with its checks; what was written is read back and looked at once more by the bounds it has itself."""
    from lobwright.operators.index import event_index
    from lobwright.sources.stages import new_path

    d = S.write_resplit(event_index(scored(spark, sf).drop("event_idx", "bids", "asks")), new_path(spark, "resplit"), 0.5, 0.3, 60)
    by = d.groupBy("symbol", "split").agg(
        F.count("*").alias("n_rows"), F.min("event_idx").alias("first_idx"), F.max("event_idx").alias("last_idx"),
        F.max(F.col("event_idx") + F.col("label_horizon_events")).alias("_reach"))
    after = by.select("symbol", F.when(F.col("split") == "valid", "train").when(F.col("split") == "test", "valid").alias("split"),
                      F.col("first_idx").alias("_next"))
    return by.join(after, ["symbol", "split"], "left").withColumn("n_reaching", F.coalesce((F.col("_reach") >= F.col("_next")).cast("int"), F.lit(0)))


@query("d3_split_manifest", "symbol:s split:s n_rows:i start_us:i end_us:i",
       "select symbol, split, count(*) as n_rows, min(event_us) as start_us, max(event_us) as end_us from seven group by 1, 2",
       extra=_SEVEN)
def _(spark, sf):
    return S.split_manifest(small_chain(spark, sf))


@query("d4_regime_held_out", "symbol:s split:s regime:s n_rows:i",
       """select symbol, case when regime = 'MOMENTUM_TOXIC' then 'test' else 'train' end as split, regime, count(*) as n_rows
          from reg group by 1, 2, 3""")
def _(spark, sf):
    return S.regime_held_out(regimed(spark, sf), "MOMENTUM_TOXIC").groupBy("symbol", "split", "regime").agg(
        F.count("*").alias("n_rows")
    )


@query("d5_asset_pairs", "train_symbol:s test_symbol:s",
       """select a.symbol as train_symbol, b.symbol as test_symbol from (select distinct symbol from raw) a
          join (select distinct symbol from raw) b on a.symbol <> b.symbol""")
def _(spark, sf):
    return S.asset_pairs(indexed_book(spark, sf))


def _split_audit_sql(source: str, purge: int) -> str:
    return f"""
      select *, case when next_split is null then 0 else greatest(horizon_events - {purge}, 0) end as horizon_overlap_rows,
             case when next_split is not null and horizon_events > {purge} then 'WARN_BOUNDARY_OVERLAP' else 'PASS' end as status,
             (next_start - end_us) / 1e3 as boundary_gap_ms
      from (select *, lead(split) over w as next_split, lead(start_us) over w as next_start
            from (select symbol, split, count(*) as n_rows, min(event_us) as start_us, max(event_us) as end_us,
                         max(label_horizon_events) as horizon_events from {source} group by 1, 2)
            window w as (partition by symbol order by start_us))"""


_D6 = "symbol:s split:s n_rows:i start_us:i end_us:i horizon_events:i next_split:s boundary_gap_ms:r4 horizon_overlap_rows:i status:s"


@query("d6_split_audit", _D6, _split_audit_sql("spl", 50))
def _(spark, sf):
    return S.split_audit(scored(spark, sf), purge=50)


@query("d6b_split_audit_unpurged", _D6, _split_audit_sql("loose", 0), extra={"loose": O.split("reg", purge=0)})
def _(spark, sf):
    return S.split_audit(S.chronological_split(regimed(spark, sf), purge=0), purge=0)


@query("d7_walk_forward", "symbol:s fold:i split:s n_rows:i",
       """select symbol, fold, case when rel < 10 then 'train' else 'test' end as split, count(*) as n_rows
          from (select symbol, fold, (event_us - t0) / 864e8 - fold * 5 as rel
                from (select *, min(event_us) over (partition by symbol) as t0 from book),
                     (select unnest(range(4)) as fold)) where rel >= 0 and rel < 15 group by 1, 2, 3""")
def _(spark, sf):
    day = 86_400_000_000
    folds = S.walk_forward(indexed_book(spark, sf), 4, 10 * day, 5 * day)
    return folds.groupBy("symbol", "fold", "split").agg(F.count("*").alias("n_rows"))
