import pytest
from helpers import book
from pyspark.sql import functions as F

from lobwright.operators import decide as D
from lobwright.operators import regimes as R
from lobwright.operators import splits as S
from lobwright.operators import stress as G
from lobwright.operators.evaluate import calibration, confusion_counts, metrics_from_counts
from lobwright.operators.ledger import candidate_counts, model_family, selection_ledger, upsert
from lobwright.operators.score import class_weights, fit_standardizer


def gate_row(spark, up=0.8, down=0.1, rel=0.001, fee=1.0):
    row = spark.createDataFrame(
        [("X", "S", up, 0.1, down, rel, 1.0, 0.0, 0.0, 0.0, "CALM_LIQUID")],
        "exchange string, symbol string, prob_up double, prob_flat double, prob_down double, rel_spread double, label_fee_bps double, "
        "latency_sensitivity_score double, liquidity_drought_score double, adverse_selection_score double, regime string",
    )
    means = spark.createDataFrame([("X", "S", -0.01, 0.0, 0.01)], "exchange string, symbol string, mean_down double, mean_flat double, mean_up double")
    d = D.gate_diagnostics(D.with_expected_edge(row, means), fee)
    return d.select(D.gate_action().alias("a")).first().a


def test_gate_goldens(spark):
    assert gate_row(spark) == 1
    assert gate_row(spark, 0.1, 0.8) == -1
    assert gate_row(spark, rel=0.02) == 0
    assert gate_row(spark, rel=0.007, fee=0.0) == 0  # equality is no trade


def test_naive_needs_one_clear_side(spark):
    df = spark.createDataFrame([(0.7, 0.1), (0.1, 0.7), (0.6, 0.6), (0.5, 0.1)], "prob_up double, prob_down double")
    assert [r.a for r in df.select(D.naive_action(F.lit(0.5)).alias("a")).collect()] == [1, -1, 0, 0]


def test_gate_variants():
    v = D.gate_variants(no_cost_gate=True)
    assert len(v) == 6 and v["no-cost-gate"] == {"theta_edge": -1.0}


CUTS = {
    "vol_q40": -0.5, "vol_q70": 0.5, "spread_q40": 1.0, "spread_q70": 2.0, "depth_q40": 10.0, "depth_q60": 20.0, "depth_drop_q10": -0.5,
    "spread_z_q80": 1.0, "momentum_abs_q80": 1.5, "adverse_q70": 1.0, "flip_q70": 0.8, "momentum_abs_q50": 0.3, "stress_q35": -1.0,
    "stress_q60": 1.0, "stress_q80": 2.0, "liquidity_q30": -1.0, "liquidity_q45": -0.5, "liquidity_q70": 1.0, "toxicity_q45": 0.5,
    "toxicity_q65": 2.0, "choppy_q60": 0.6, "drought_q55": 0.5, "drought_q70": 1.0,
}
QUIET = {"vol_score": 0.0, "rel_spread": 1.5, "total_depth_10": 15.0, "depth_drop_top10": 0.0, "spread_z_1m": 0.0, "momentum_score": 0.5,
         "adverse_selection_score": 0.0, "choppiness_score": 0.1, "liquidity_drought_score": 0.0, "depth_z_1m": 0.0}


@pytest.mark.parametrize(
    "change, regime",
    [
        ({"depth_drop_top10": -0.6, "spread_z_1m": 1.2}, "LIQUIDITY_DROUGHT"),
        ({"depth_drop_top10": -0.6, "spread_z_1m": 1.2, "momentum_score": -2.0, "adverse_selection_score": 2.0}, "LIQUIDITY_DROUGHT"),
        ({"momentum_score": -2.0, "adverse_selection_score": 2.0}, "MOMENTUM_TOXIC"),
        ({"vol_score": 0.6, "rel_spread": 2.0, "total_depth_10": 10.0}, "VOLATILE_ILLIQUID"),
        ({"choppiness_score": 0.9, "momentum_score": 0.1}, "CHOPPY_MEAN_REVERTING"),
        ({"vol_score": 0.6}, "SHOCK_RECOVERY"),
        ({"vol_score": 0.6, "rel_spread": 0.9, "total_depth_10": 25.0, "spread_z_1m": 1.1}, "VOLATILE_LIQUID"),
        ({"vol_score": -0.6, "rel_spread": 2.5, "total_depth_10": 5.0}, "CALM_ILLIQUID"),
        ({"vol_score": -0.6, "rel_spread": 0.5, "total_depth_10": 25.0}, "CALM_LIQUID"),
        ({"spread_z_1m": 0.6, "liquidity_drought_score": 0.6}, "MILD_LIQUIDITY_STRESS"),
        ({}, "BALANCED_TRANSITION"),
        ({"spread_z_1m": 2.5, "depth_drop_top10": 0.0}, "UNKNOWN"),
    ],
)
def test_each_regime_rule_and_its_rank(spark, change, regime):
    values = {**QUIET, **change}
    row = spark.createDataFrame([("X", "S", *values.values())], "exchange string, symbol string, " + ", ".join(f"{c} double" for c in values))
    cuts = spark.createDataFrame([("X", "S", *CUTS.values())], "exchange string, symbol string, " + ", ".join(f"{c} double" for c in CUTS))
    assert R.apply_regimes(row, cuts).first().regime == regime


def test_thresholds_ignore_rows_after_the_prefix(spark):
    def frame(late):
        rows = [("X", "S", i, *[float((i * 37 + k * 11) % 101) if i < 120 else late for k in range(len(QUIET))]) for i in range(200)]
        return spark.createDataFrame(rows, "exchange string, symbol string, event_idx long, " + ", ".join(f"{c} double" for c in QUIET))

    assert R.fit_thresholds(frame(0.0)).first() == R.fit_thresholds(frame(1e6)).first()


def test_purged_split(spark):
    df = spark.createDataFrame([("X", "S", i, i * 1_000_000) for i in range(20)], "exchange string, symbol string, event_idx long, event_us long")
    out = S.chronological_split(df, 0.6, 0.2, 2).toPandas()
    got = {k: sorted(g.event_idx) for k, g in out.groupby("split")}
    assert got == {"train": list(range(10)), "valid": [12, 13], "test": [16, 17, 18, 19]}


def test_split_audit_warns_without_purge(spark):
    rows = [("S", s, i, 50) for s, a, b in (("train", 0, 80), ("valid", 80, 110), ("test", 110, 140)) for i in range(a, b)]
    df = spark.createDataFrame(rows, "symbol string, split string, event_us long, label_horizon_events long")
    out = {r.split: r for r in S.split_audit(df, 0).collect()}
    assert out["train"].horizon_overlap_rows == 50 and out["train"].status == out["valid"].status == "WARN_BOUNDARY_OVERLAP"
    assert out["test"].status == "PASS" and out["test"].next_split is None


def test_resplit_drops_stale_predictions(spark):
    rows = [("X", "S", i, 0.1, 0.2, 0.7, "UP", "test") for i in range(20)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, event_idx long, prob_down double, prob_flat double, prob_up double, pred_label string, split string")
    out = S.resplit(df, 0.6, 0.2, 2)
    assert out.count() == 16 and not set(S.PREDICTION_COLUMNS) & set(out.columns)


def test_standardizer_reads_train_only(spark):
    rows = [("X", "S", "train", float(i)) for i in range(6)] + [("X", "S", "valid", 1000.0), ("X", "S", "test", -1000.0)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, split string, f double")
    assert fit_standardizer(df, ["f"]).first().f__mean == 2.5


def test_class_weights_cover_absent_classes(spark):
    df = spark.createDataFrame([("X", "S", "train", "UP")] * 3 + [("X", "S", "train", "FLAT")], "exchange string, symbol string, split string, label string")
    w = {r.label: r.class_weight for r in class_weights(df).collect()}
    assert w == {"UP": pytest.approx(4 / 9), "FLAT": pytest.approx(4 / 3), "DOWN": pytest.approx(4 / 3)}


def test_stress_grid_shape_and_errors():
    from lobwright.operators.fills import Execution

    cells = G.scenarios(Execution())
    assert len(cells) == 15 and {a for a, _, _ in cells} == set(G.STRESS_GRID)
    with pytest.raises(ValueError):
        G.check_grid({"weather": (1,)})
    with pytest.raises(ValueError):
        G.check_grid({"fee_bps": ()})


def test_robustness_goldens(spark):
    fee = spark.createDataFrame([("m", float(x), y) for x, y in ((0, 10.0), (1, 5.0), (2, 0.0))], "m string, stress_level double, net_pnl double")
    assert G.robustness_auc(fee, ["m"]).first().robustness_auc == pytest.approx(5.0)
    assert G.robustness_auc(fee.filter("stress_level = 0"), ["m"]).first().robustness_auc is None
    lat = spark.createDataFrame([("m", float(x), y) for x, y in ((0, 10.0), (1, 7.0), (5, 4.0))], "m string, stress_level double, net_pnl double")
    assert G.latency_half_life(lat, ["m"]).first().latency_half_life == 5.0
    reg = spark.createDataFrame([("m", "A", 10.0), ("m", "B", -2.0)], "m string, regime string, net_pnl double")
    r = G.regime_spread(reg, ["m"]).first()
    assert (r.worst_regime_return, r.regime_gap) == (-2.0, 12.0)


def test_metrics_are_zero_safe_and_fixed_to_three_classes(spark):
    df = spark.createDataFrame([("UP", "UP"), ("UP", "UP")], "label string, pred_label string")
    m = metrics_from_counts(confusion_counts(df, []), []).first()
    assert m.accuracy == 1.0 and m.macro_f1 == pytest.approx(1 / 3) and m.mcc == 0.0


def test_calibration_bounds(spark):
    rows = [("S", "test", "UP", "UP", 0.0, 0.0, 1.0), ("S", "test", "UP", "DOWN", 1.0, 0.0, 0.0), ("S", "train", "UP", "UP", 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, split string, label string, pred_label string, prob_down double, prob_flat double, prob_up double")
    c = calibration(df, ["symbol"]).first()
    assert c.n_rows == 2 and c.ece == pytest.approx(0.5) and c.brier_score == pytest.approx(1.0)


def tuning(spark, split):
    rows = [("m", "p", split, t, t == 0.6, 5, n, v) for t, n, v in ((0.5, 20, -5.0), (0.6, 10, 2.0), (0.7, 5, 3.0))]
    return spark.createDataFrame(rows, "model string, policy string, split string, theta double, selected boolean, n_trade_days long, n_trades long, net_pnl double")


def test_ledger_flags_test_selection(spark):
    results = spark.createDataFrame([("m", "p", 1.5)], "model string, policy string, net_pnl double")
    ok = selection_ledger(tuning(spark, "valid"), results, ["model", "policy"]).first()
    assert (ok.theta, ok.selection_audit_status, ok.test_net_pnl) == (0.6, "PASS_VALIDATION_ONLY", 1.5)
    assert selection_ledger(tuning(spark, "test"), results, ["model", "policy"]).first().selection_audit_status == "FAIL_TEST_SELECTION"
    c = candidate_counts(tuning(spark, "valid"), ["model", "policy"]).first()
    assert (c.n_candidates, c.n_selected, c.selection_sources) == (3, 1, "valid")


def test_upsert_and_families(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "model string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "model string, v int")
    assert {(r.model, r.v) for r in upsert(old, new, ["model"]).collect()} == {("a", 1), ("b", 9), ("c", 3)}
    names = spark.createDataFrame([("asset_sgd",), ("XGBoost_x",), ("my_sgd",), ("zz",)], "m string")
    assert [r.f for r in names.select(model_family(F.col("m")).alias("f")).collect()] == [
        "asset_heldout_streaming_sgd", "xgboost_gpu_tabular", "streaming_sgd_tabular", "unknown"]


def test_walk_forward_roles(spark):
    df = book(spark, 30)
    out = S.walk_forward(df, 2, 10_000_000, 5_000_000).groupBy("fold", "split").count().collect()
    assert {(r.fold, r.split): r["count"] for r in out} == {(0, "train"): 10, (0, "test"): 5, (1, "train"): 10, (1, "test"): 5}


def test_folds_of_a_row_are_not_listed_first(spark):
    from lobwright.operators.splits import walk_forward

    df = spark.createDataFrame([("X", "S", t) for t in range(0, 400, 3)], "exchange string, symbol string, event_us long")
    got = sorted((r["event_us"], r["fold"], r["split"]) for r in walk_forward(df, 6, 40, 15, purge_us=5).collect())
    want = []
    for t in range(0, 400, 3):
        for fold in range(6):
            rel = t - fold * 15
            if 0 <= rel < 35:
                want.append((t, fold, "train"))
            elif 40 <= rel < 55:
                want.append((t, fold, "test"))
    assert got == sorted(want)


def test_labels_without_a_horizon_drop_rows_without_a_price(spark):
    from lobwright.operators.labels import add_labels

    df = spark.createDataFrame([("X", "S", 0, 1.0, 0.1), ("X", "S", 1, None, 0.1)], "exchange string, symbol string, event_idx long, mid_price double, rel_spread double")
    assert [r["event_idx"] for r in add_labels(df, horizon=0).collect()] == [0]
