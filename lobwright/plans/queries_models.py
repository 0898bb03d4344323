"""Trained models, transfer between symbols, clustering, and the streaming forms."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lobwright.operators import decide as D
from lobwright.operators import evaluate as K
from lobwright.operators import score as M
from lobwright.operators.cluster import RESIDUAL, ROUNDS, alignment, residual_clusters, residual_mixture
from lobwright.operators.labels import class_return_means, label_columns
from lobwright.operators.regimes import apply_regimes, fit_thresholds
from lobwright.operators.splits import asset_pairs
from lobwright.operators.tune import evaluate_grid, policy_grid, select_threshold, winner_grid, winner_trades
from lobwright.plans import oracle as O
from lobwright.plans.chain import EXECUTION, labelled, regimed, scored, tuned
from lobwright.plans.registry import query
from lobwright.sources.book import events_book
from lobwright.sources.stages import checkpoint_root, cut, per_key, stage
from lobwright.streaming.live import LatestUpdate, LiveBook, live_features, minute_audit, run_available

_QUALITY = "model:s split:s n_rows:i accuracy:r6 macro_f1:r6 weighted_f1:r6 balanced_accuracy:r6 mcc:r6"


def _quality(rows, name):
    counts = K.confusion_counts(rows, ["split"])
    return K.metrics_from_counts(counts, ["split"]).withColumn("model", F.lit(name))


@query("m3_linear_training", _QUALITY)
def _(spark, sf):
    rows = scored(spark, sf).drop("prob_down", "prob_flat", "prob_up", "pred_label")
    return _quality(M.score_model(rows, M.train_linear(rows)), "linear")


_GAPS = "select label, " + ", ".join(f"case when event_idx % 11 = {i} then null else {c} end as {c}" for i, c in enumerate(M.MODEL_FEATURES[:10])) \
    + ", " + ", ".join(M.MODEL_FEATURES[10:]) + " from scored where split = 'train'"


@query("m3b_training_preparation", "kind:s name:s value:r8",
       "select 'weight' as kind, label as name, (select count(*) from gaps) / (3e0 * count(*)) as value from gaps group by label union all "
       + " union all ".join(
           f"select unnest(['median', 'mean', 'std']), '{c}', unnest([m, avg(coalesce({c}, m)), stddev_samp(coalesce({c}, m))]) "
           f"from gaps cross join (select median({c}) as m from gaps) group by m" for c in M.MODEL_FEATURES),
       extra={"gaps": _GAPS})
def _(spark, sf):
    """What the linear model and the trees are trained with: class weights, medians, and the scaler after them, on rows with gaps."""
    rows = scored(spark, sf).withColumns({c: F.when(F.col("event_idx") % 11 != i, F.col(c)) for i, c in enumerate(M.MODEL_FEATURES[:10])})
    medians = M.fit_medians(rows)
    filled = M.imputer(medians).transform(rows.filter("split = 'train'"))
    names = M.MODEL_FEATURES
    fit = filled.agg(*[F.avg(f"_f_{c}").alias(f"m_{c}") for c in names], *[F.stddev_samp(f"_f_{c}").alias(f"s_{c}") for c in names]).first()
    out = [("weight", k, v) for k, v in M.balanced_weights(M.label_counts(rows)).items()]
    for c in names:
        out += [("median", c, medians[c]), ("mean", c, fit[f"m_{c}"]), ("std", c, fit[f"s_{c}"])]
    return spark.createDataFrame(out, "kind string, name string, value double")


@query("m4_tree_training", _QUALITY)
def _(spark, sf):
    rows = scored(spark, sf).drop("prob_down", "prob_flat", "prob_up", "pred_label")
    return _quality(M.score_model(rows, M.train_trees(rows)), "trees")


@query("m4b_boosted_training", _QUALITY)
def _(spark, sf):
    """Boosted trees, one class against the rest, of 150 rounds and depth 5."""
    rows = scored(spark, sf).drop("prob_down", "prob_flat", "prob_up", "pred_label")
    return _quality(M.score_boosted(rows, M.train_boosted(rows)), "boosted")


_PAIR = "a.symbol || '>' || b.symbol as symbol"
_ASSETS = "(select distinct symbol from scored)"
_TRANSFER = {
    "moved": f"select b.* exclude (symbol), {_PAIR} from scored b join {_ASSETS} a on a.symbol <> b.symbol where b.split = 'test'",
    "moved_means": f"select a.* exclude (symbol), {_PAIR} from means a join {_ASSETS} b on a.symbol <> b.symbol",
    "moved_winners": f"select a.* exclude (symbol), {_PAIR} from winners a join {_ASSETS} b on a.symbol <> b.symbol",
    "moved_test": O.DECIDED.replace("from scored s join means", "from moved s join moved_means"),
    "moved_signals": "select *, 1 as latency, 1e0 as sm, 1e0 as dm from (" + O.grid_signals("moved_test", "moved_winners") + ")",
    **O.trips("mv", "moved_signals", "moved_test", "s.policy"),
    "moved_thin": O.thinned("mv_trips", "exchange, symbol, policy", 3),
    "moved_trades": O.charged("moved_thin"),
}


def _moved(df, pairs, side):
    """Rows of ``df`` under the key of every direction in which their symbol is the ``side``."""
    named = pairs.select(F.col(side).alias("symbol"), F.concat("train_symbol", F.lit(">"), "test_symbol").alias("_pair"))
    return df.join(named, "symbol").drop("symbol").withColumnRenamed("_pair", "symbol")


def _directions(df):
    """The two symbols of each direction, and zeros where nothing was traded."""
    return df.na.fill(0, ["n_trades"]).na.fill(0.0, ["gross_pnl", "net_pnl"]).withColumns(
        {"train_symbol": F.split_part("symbol", F.lit(">"), F.lit(1)), "test_symbol": F.split_part("symbol", F.lit(">"), F.lit(2))})


@query("m6b_transfer_all_pairs", "train_symbol:s test_symbol:s policy:s theta:r11 n_trades:i gross_pnl:r5 net_pnl:r5",
       """select split_part(w.symbol, '>', 1) as train_symbol, split_part(w.symbol, '>', 2) as test_symbol, w.policy, w.theta,
                 coalesce(n_trades, 0) as n_trades, coalesce(gross_pnl, 0e0) as gross_pnl, coalesce(net_pnl, 0e0) as net_pnl
          from moved_winners w left join (select symbol, policy, count(*) as n_trades, sum(gross_pnl) as gross_pnl, sum(net_pnl) as net_pnl
                                          from moved_trades group by 1, 2) using (symbol, policy)""", extra=_TRANSFER)
def _(spark, sf):
    """Every direction at once: class means and thresholds of the source on the target's test rows.

    A direction is a key of its own, so the target's rows are repeated once per source; their number grows with that of
    symbols, never with that of rows.
    """
    from lobwright.operators.fills import summarize

    rows = scored(spark, sf)
    pairs = per_key(asset_pairs(rows))

    winners = per_key(_moved(winner_grid(tuned(spark, sf)), pairs, "train_symbol"))
    means = per_key(_moved(class_return_means(rows), pairs, "train_symbol"))
    target = _moved(rows.filter("split = 'test'").drop("bids", "asks"), pairs, "test_symbol")
    test = cut(D.gate_diagnostics(D.with_expected_edge(target, means)), "moved_test")
    trades = summarize(winner_trades(test, winners, EXECUTION), ["symbol", "policy"])
    return _directions(winners.select("symbol", "policy", "theta").join(trades, ["symbol", "policy"], "left"))


def _renamed(blocks: dict[str, str], names: dict[str, str]) -> dict[str, str]:
    """``blocks`` under new names, with their references to each other."""
    import re

    pattern = re.compile(r"\b(" + "|".join(map(re.escape, names)) + r")\b(?!\.)")
    return {names[k]: pattern.sub(lambda m: names[m.group()], text) for k, text in blocks.items()}


_TUNING = ("valid_grid", "valid_signals", "v_sig", "v_need", "v_legs", "v_fill", "v_leg", "v_trips", "valid_thin", "valid_trades", "valid_summary", "tried", "tuned", "winners")
_TRAINED = {
    **O.trained("src", "scored", M.MODEL_FEATURES),
    "own_scored": O.scored_by("(select * from scored where split = 'valid')", "src_model", M.MODEL_FEATURES),
    "own_valid": O.DECIDED.replace("from scored s join", "from own_scored s join"),
    **_renamed({k: O.BLOCKS[k] for k in _TUNING}, {"valid": "own_valid", **{k: f"own_{k}" for k in _TUNING}}),
    "moved": f"select b.* exclude (symbol), {_PAIR} from scored b join {_ASSETS} a on a.symbol <> b.symbol where b.split = 'test'",
    "moved_means": _TRANSFER["moved_means"],
    "moved_model": f"select a.* exclude (symbol), {_PAIR} from src_model a join {_ASSETS} b on a.symbol <> b.symbol",
    "moved_winners": f"select a.* exclude (symbol), {_PAIR} from own_winners a join {_ASSETS} b on a.symbol <> b.symbol",
    "moved_scored": O.scored_by("moved", "moved_model", M.MODEL_FEATURES),
    "moved_test": O.DECIDED.replace("from scored s join means", "from moved_scored s join moved_means"),
    **{k: v for k, v in _TRANSFER.items() if k.startswith(("mv_", "moved_signals", "moved_thin", "moved_trades"))},
    "moved_quality": """
      select symbol, sum(n) as n_rows, sum(h) / sum(n) as accuracy, sum(b) / sum(n) as brier_score, sum(abs(h - c)) / sum(n) as ece
      from (select symbol, least(floor(round(greatest(prob_down, prob_flat, prob_up) * 10, 9)), 9) as bin, count(*) as n,
                   sum(greatest(prob_down, prob_flat, prob_up)) as c, sum((label = pred_label)::int) as h,
                   sum((prob_down - (label = 'DOWN')::int) ** 2 + (prob_flat - (label = 'FLAT')::int) ** 2 + (prob_up - (label = 'UP')::int) ** 2) as b
            from moved_scored group by 1, 2) group by 1""",
}


@query("m6_transfer", "train_symbol:s test_symbol:s policy:s theta:r9 n_trades:i gross_pnl:r5 net_pnl:r5 n_rows:i accuracy:r6 brier_score:r6 ece:r6",
       """select split_part(w.symbol, '>', 1) as train_symbol, split_part(w.symbol, '>', 2) as test_symbol, w.policy, w.theta,
                 coalesce(n_trades, 0) as n_trades, coalesce(gross_pnl, 0e0) as gross_pnl, coalesce(net_pnl, 0e0) as net_pnl,
                 q.n_rows, q.accuracy, q.brier_score, q.ece
          from moved_winners w join moved_quality q using (symbol)
          left join (select symbol, policy, count(*) as n_trades, sum(gross_pnl) as gross_pnl, sum(net_pnl) as net_pnl
                     from moved_trades group by 1, 2) using (symbol, policy)""", extra=_TRAINED)
def _(spark, sf):
    """Trained models, class means and thresholds of every source; a target is met on its test rows only, in every direction."""
    from lobwright.operators.fills import summarize

    rows = scored(spark, sf)
    plain = rows.drop("prob_down", "prob_flat", "prob_up", "pred_label", "bids", "asks")
    models, means = M.train_grouped(plain), class_return_means(rows)
    own = M.score_grouped(plain.filter("split = 'valid'"), models)
    valid = cut(D.gate_diagnostics(D.with_expected_edge(own, means)), "own_valid")
    winners = winner_grid(select_threshold(evaluate_grid(valid, cut(policy_grid(valid), "grid"), EXECUTION), valid))
    pairs = per_key(asset_pairs(rows))
    moved_winners = per_key(_moved(winners, pairs, "train_symbol"))
    target = M.score_grouped(_moved(plain.filter("split = 'test'"), pairs, "test_symbol"), per_key(_moved(models, pairs, "train_symbol")))
    test = cut(D.gate_diagnostics(D.with_expected_edge(target, per_key(_moved(means, pairs, "train_symbol")))), "target_test")
    trades = summarize(winner_trades(test, moved_winners, EXECUTION), ["symbol", "policy"])
    quality = K.calibration(test, ["symbol"]).select("symbol", "n_rows", "accuracy", "brier_score", "ece")
    out = moved_winners.select("symbol", "policy", "theta").join(quality, "symbol").join(trades, ["symbol", "policy"], "left")
    return _directions(out)


@query("r10_residual_clusters", "algorithm:s regime:s cluster:i n_rows:i share_within_regime:r6 share_within_cluster:r6")
def _(spark, sf):
    columns = ["rel_spread", "total_depth_10", "vol_score", "liquidity_score", "stress_score", "directional_toxicity_score"]
    return alignment(cut(residual_clusters(regimed(spark, sf), columns).select("regime", "kmeans_cluster", "gmm_cluster"), "clusters"))


_CLUSTERED = ("rel_spread", "total_depth_10", "vol_score", "liquidity_score", "stress_score", "directional_toxicity_score")


def _mixture_blocks(d: int = len(_CLUSTERED), k: int = 3) -> dict[str, str]:
    """The mixture in SQL: a one-row table of parameters for each round, made from the rows and the table before it."""
    z = range(d)
    blocks = {
        "mix_raw": "select symbol, event_idx, regime, " + ", ".join(f"coalesce({c}, 0e0)::double as x{i}" for i, c in enumerate(_CLUSTERED))
        + f" from reg where regime in ({', '.join(repr(r) for r in RESIDUAL)})",
        "mix_fit": "select " + ", ".join(f"avg(x{i}) as m{i}, stddev_pop(x{i}) as s{i}" for i in z) + " from mix_raw",
        "mix_z": "select symbol, event_idx, regime, " + ", ".join(f"(x{i} - m{i}) / case when s{i} = 0 then 1e0 else s{i} end as z{i}" for i in z) + " from mix_raw cross join mix_fit",
        "mix_p0": "select " + ", ".join(f"{1 / k!r}::double as w{j}, " + ", ".join(f"{j - (k - 1) / 2!r}::double as m{j}_{i}, 1e0 as v{j}_{i}" for i in z) for j in range(k)),
    }

    def logs(p: str) -> str:
        return "select symbol, event_idx, regime, " + ", ".join(f"z{i}" for i in z) + "".join(
            f", ln(w{j}) - " + " - ".join(f"0.5e0 * (ln(2 * pi() * v{j}_{i}) + (z{i} - m{j}_{i}) ** 2 / v{j}_{i})" for i in z) + f" as l{j}" for j in range(k)
        ) + f" from mix_z cross join {p}"

    total = " + ".join(f"exp(l{j} - greatest(l0, l1, l2))" for j in range(k))
    for r in range(1, ROUNDS + 1):
        shares = f"select *, {', '.join(f'exp(l{j} - greatest(l0, l1, l2)) / ({total}) as r{j}' for j in range(k))} from ({logs(f'mix_p{r - 1}')})"
        blocks[f"mix_p{r}"] = "select " + ", ".join(
            f"sum(r{j}) / count(*) as w{j}, " + ", ".join(
                f"sum(r{j} * z{i}) / sum(r{j}) as m{j}_{i}, greatest(sum(r{j} * z{i} * z{i}) / sum(r{j}) - (sum(r{j} * z{i}) / sum(r{j})) ** 2, 0e0) + 1e-6 as v{j}_{i}"
                for i in z) for j in range(k)) + f" from ({shares})"
    blocks["mix_best"] = f"""
      select regime, case when round(l0, 9) >= round(l1, 9) and round(l0, 9) >= round(l2, 9) then 0 when round(l1, 9) >= round(l2, 9) then 1 else 2 end as cluster
      from ({logs(f'mix_p{ROUNDS}')})"""
    return blocks


@query("r10b_residual_mixture", "regime:s cluster:i n_rows:i share_within_regime:r6 share_within_cluster:r6 weight:r6 first_mean:r5 last_variance:r5",
       f"""select regime, cluster, n_rows, n_rows / sum(n_rows) over (partition by regime) as share_within_regime,
                  n_rows / sum(n_rows) over (partition by cluster) as share_within_cluster, weight, first_mean, last_variance
           from (select regime, cluster, count(*)::double as n_rows from mix_best group by 1, 2)
           join (select 0 as cluster, w0 as weight, m0_0 as first_mean, v0_5 as last_variance from mix_p{ROUNDS} union all
                 select 1, w1, m1_0, v1_5 from mix_p{ROUNDS} union all select 2, w2, m2_0, v2_5 from mix_p{ROUNDS}) using (cluster)""", extra=_mixture_blocks())
def _(spark, sf):
    """Diagonal mixture of all residual rows: how its clusters line up with the regimes, and its components."""
    placed, mixture = residual_mixture(regimed(spark, sf), _CLUSTERED)
    parts = spark.createDataFrame([(j, w, m[0], v[-1]) for j, (w, m, v) in enumerate(mixture)], "cluster long, weight double, first_mean double, last_variance double")
    return alignment(placed, ("gmm_cluster",)).join(parts, "cluster")


# ---------------------------------------------------------------- streaming

SLICES = 4


def _replay(spark, sf, make_sink, transform_stream=lambda s: s, mode="append", defects=False):
    """Feeds the whole table in four time slices to a stream, each slice one run over what has newly arrived."""
    root = os.path.join(checkpoint_root(spark), "lobwright", spark.sparkContext.applicationId, f"live-{os.urandom(4).hex()}")
    rows = events_book(spark, sf, defects)
    span = rows.agg(F.min("arrival").alias("lo"), F.max("arrival").alias("hi"))
    cutpoints = span.first()
    lo, width = cutpoints["lo"], (cutpoints["hi"] - cutpoints["lo"]) // SLICES + 1
    sink = make_sink(os.path.join(root, "result"))
    source = os.path.join(root, "in")
    for i in range(SLICES):
        part = rows.filter((F.col("arrival") >= lo + i * width) & (F.col("arrival") < lo + (i + 1) * width))
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        run_available(transform_stream(stream), sink, os.path.join(root, "progress"), mode)
    return sink


_LIVE = "symbol:s event_idx:i rel_spread:r10 ofi_5:r4 realized_vol_100:r10 return_autocorr_100:r6 vol_score:r5 momentum_score:r5 depth_drop_top10:r7"


@query("x1_live_features", _LIVE, "select * from inputs")
def _(spark, sf):
    def make(root):
        return LiveBook(root)

    return _replay(spark, sf, make).results(spark)


@query("x2_live_decisions", "symbol:s event_idx:i regime:s prob_up:r8 prob_down:r8 action:i",
       f"""select symbol, event_idx, regime, prob_up, prob_down, {O.beyond('estimated_edge', O.required())} as action from live_decided""",
       extra={"live_scr": O.scores("inputs"),
              "live_reg": f"select s.*, {O.cascade()} as regime from live_scr s join thr t using ({O.K})",
              "live_scored": O.softmax("live_reg"),
              "live_decided": O.DECIDED.replace("from scored s", "from live_scored s")})
def _(spark, sf):
    """Batches are scored and gated with thresholds and class means fitted beforehand."""
    thresholds = stage(spark, sf, "thresholds", lambda: fit_thresholds(labelled(spark, sf)))
    means = stage(spark, sf, "class_means", lambda: class_return_means(scored(spark, sf)))

    def decide(rows):
        scored_rows = M.score_linear(apply_regimes(live_features(rows), thresholds))
        out = D.gate_diagnostics(D.with_expected_edge(scored_rows, means))
        return out.withColumn("action", D.gate_action()).select(
            "exchange", "symbol", "event_idx", "regime", "prob_up", "prob_down", "action")

    return _replay(spark, sf, lambda root: LiveBook(root, decide)).results(spark)


@query("x3_live_minute_audit", "symbol:s start_us:i n_rows:i n_crossed:i n_missing_sequence:i spread_mean:r7",
       """select symbol, event_us // 60000000 * 60000000 as start_us, count(*) as n_rows,
                 count(*) filter (where asks[1].price - bids[1].price < 0) as n_crossed,
                 count(*) filter (where sequence_number is null) as n_missing_sequence,
                 avg(asks[1].price - bids[1].price) as spread_mean from bad_t where event_us is not null group by 1, 2""")
def _(spark, sf):
    from lobwright.operators.clean import with_event_time

    return _replay(
        spark, sf, lambda root: LatestUpdate(root, ["symbol", "start_us"]),
        lambda s: minute_audit(with_event_time(s)), mode="update", defects=True,
    ).results(spark)


@query("x4_delayed_labels", "symbol:s event_idx:i label:s future_ret_h:r10", "select * from lab")
def _(spark, sf):
    """A row is emitted when its 50th successor has arrived."""
    from lobwright.operators.chunks import ChunkSql, drop_halo, with_halo
    from lobwright.operators.features import price_features

    def transform(rows):
        d = with_halo(price_features(rows).drop("bids", "asks"), ahead=50)
        d = d.selectExpr("*", f"{ChunkSql().lead('mid_price', 50)} as _future")
        d = drop_halo(d.filter("_future is not null"))
        return label_columns(d, F.col("_future"), 50, 1.0, 0.5, 1e-9).drop("_future")

    return _replay(spark, sf, lambda root: LiveBook(root, transform, delay=50, look_back=1)).results(spark)


