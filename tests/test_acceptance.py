from lobwright.operators import acceptance as A


def statuses(df):
    return {r.symbol: (r.status, r.n, r.figure) for r in df.collect()}


def test_rules_on_both_sides_of_their_bars(spark):
    m = [("a", f"r{k}", f) for k, f in enumerate((0.30, 0.31, 0.33))] + [("b", f"r{k}", f) for k, f in enumerate((0.30, 0.31, 0.3299))]
    m += [("c", "r0", 0.1), ("c", "r1", 0.9), ("d", "r0", None)]
    got = statuses(A.regime_variation(spark.createDataFrame(m, "symbol string, regime string, macro_f1 double"), ["symbol"]))
    assert got == {"a": ("PASS", 3, 0.03), "b": ("PARTIAL", 3, 0.0299), "c": ("PARTIAL", 2, 0.8), "d": ("PARTIAL", 1, 0.0)}

    schema = "symbol string, gross_pnl double, net_pnl double"
    tuned = spark.createDataFrame([("a", 1.0, -1.0), ("b", -1.0, -2.0), ("c", 1.0, 0.5), ("d", None, None)], schema)
    plain = spark.createDataFrame([("b", 1.0, 0.0), ("c", -3.0, -4.0)], schema)
    assert statuses(A.edge_lost(tuned, plain, ["symbol"])) == {"a": ("PASS", 1, 1.0), "b": ("PARTIAL", 2, 0.0), "c": ("PASS", 2, 1.0), "d": ("PARTIAL", 1, 0.0)}

    axes = spark.createDataFrame([("a", x) for x in "fee"] + [("b", x) for x in "fld"], "symbol string, stress_axis string")
    assert statuses(A.stress_axes(axes, ["symbol"])) == {"a": ("PARTIAL", 3, 2.0), "b": ("PASS", 3, 3.0)}

    wins = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, False)], "symbol string, comparable boolean, won boolean")
    assert statuses(A.gate_status(wins, ["symbol"], "won", "FAIL")) == {"a": ("PASS", 1, 1.0), "b": ("FAIL", 1, 0.0), "c": ("PARTIAL", 0, 0.0)}


def test_intervals_support_only_if_sound_and_clear(spark):
    rows = [("clear", 5, 1000, 0.1), ("clear", 5, 1000, 0.2), ("mixed", 5, 1000, 0.1), ("mixed", 5, 1000, 0.0), ("below", 5, 1000, -1.0),
            ("one_day", 1, 1000, 0.1), ("few", 5, 999, 0.1), ("null", 5, 1000, None)]
    d = spark.createDataFrame(rows, "symbol string, n_days int, n_resamples int, low double")
    got = {k: v[0] for k, v in statuses(A.interval_support(d, ["symbol"])).items()}
    assert got == {"clear": "PASS", "mixed": "PARTIAL", "below": "PARTIAL", "one_day": "FAIL", "few": "FAIL", "null": "PARTIAL"}


def test_bar_fails_what_is_missing_and_claims_take_the_worst(spark):
    groups = spark.createDataFrame([("a",), ("b",), ("a",)], "symbol string")
    axes = A.stress_axes(spark.createDataFrame([("a", x) for x in "fld"], "symbol string, stress_axis string"), ["symbol"])
    bar = A.acceptance_bar(groups, {"stress_axes": axes}, ["symbol"])
    got = {(r.symbol, r.criterion_id): r.status for r in bar.collect()}
    assert len(got) == 14 and [k for k, v in got.items() if v != "FAIL"] == [("a", "C06")]
    claims = A.claim_status(bar, {"x": ("stress_axes",), "y": ("stress_axes", "regime_gap")}, ["symbol"])
    assert {(r.symbol, r.claim): (r.claim_status, r.n_criteria, r.n_passed) for r in claims.collect()} == {
        ("a", "x"): ("SUPPORTED", 1, 1), ("a", "y"): ("NOT_SUPPORTED", 2, 1), ("b", "x"): ("NOT_SUPPORTED", 1, 0), ("b", "y"): ("NOT_SUPPORTED", 2, 0)}
    assert A.acceptance_bar(groups.limit(0), {"stress_axes": axes}, ["symbol"]).count() == 0
