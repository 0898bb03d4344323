"""Models trained for all keys at once, and what fitted numbers have read."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lobwright.operators import provenance
from lobwright.operators.labels import LABELS
from lobwright.operators.ledger import overfitting_readiness
from lobwright.operators.score import score_grouped, train_grouped

FEATURES = ("u", "v")


def rows():
    rng = np.random.default_rng(3)
    out = []
    for symbol, slope in (("A", 2.0), ("B", -2.0), ("ONE", 0.0)):
        for i in range(300):
            u, v = rng.normal(5, 3), rng.normal() * 1e-4
            side = slope * (u - 5) / 3 + rng.normal() * 0.3
            label = "UP" if symbol == "ONE" else LABELS[int(side > 0.5) + int(side > -0.5)]
            out.append(("X", symbol, i, "train" if i < 200 else "test", label, float(u), None if i % 50 == 7 else float(v)))
    return pd.DataFrame(out, columns=["exchange", "symbol", "event_idx", "split", "label", "u", "v"])


def by_hand(train, steps):
    """The same steps in numpy."""
    x = train[list(FEATURES)]
    z = np.column_stack([((x - x.mean()) / x.std(ddof=1)).fillna(0.0).to_numpy(), np.ones(len(x))])
    y = np.array([[label == c for c in LABELS] for label in train["label"]], dtype=float)
    balance = (y @ (len(y) / (3 * np.maximum(y.sum(axis=0), 1))))[:, None]
    w = before = np.zeros((3, z.shape[1]))
    for t in range(steps):
        v = w + t / (t + 3) * (w - before)
        e = np.exp(z @ v.T - (z @ v.T).max(axis=1, keepdims=True))
        slope = (balance * (e / e.sum(axis=1, keepdims=True) - y)).T @ z / len(z)
        w, before = v - 0.125 * (slope + 1e-4 * v), w
    return w


def test_all_keys_at_once(spark):
    data = rows()
    df = spark.createDataFrame(data)
    models = train_grouped(df, FEATURES, steps=8)
    found = {r["symbol"]: np.array(r["_weights"]).reshape(3, 3) for r in models.collect()}
    for symbol, part in data[data["split"] == "train"].groupby("symbol"):
        assert np.abs(found[symbol] - by_hand(part, 8)).max() < 1e-8
    scored = score_grouped(df.filter("split = 'test'"), models, FEATURES)
    hits = {r["symbol"]: r["hit"] for r in scored.groupBy("symbol").agg(F.avg((F.col("label") == F.col("pred_label")).cast("int")).alias("hit")).collect()}
    assert hits["ONE"] == 1.0 and hits["A"] > 0.6 and hits["B"] > 0.6, hits
    assert scored.filter("abs(prob_down + prob_flat + prob_up - 1) > 1e-9").count() == 0


def test_reads_follow_rows_under_other_keys(spark):
    df = provenance.with_origin(spark.createDataFrame([("A", "train"), ("A", "valid"), ("B", "test"), ("C", None)], "symbol string, split string"))
    moved = df.filter("symbol <> 'C'").withColumn("symbol", F.lit("A"))
    own = {r["symbol"]: r["bits"] for r in provenance.own_reads([df], ["symbol"], "bits").collect()}
    assert own == {"A": 3, "B": 4, "C": 8}
    assert provenance.own_reads([moved], ["symbol"], "bits").first()["bits"] == 3 | 8
    names = spark.range(16).select(provenance.split_names(F.col("id").cast("int")).alias("s")).collect()
    assert names[2]["s"] == "valid" and names[13]["s"] == "train,test,unknown" and names[0]["s"] == ""


def test_protocol_fails_where_the_target_was_read(spark):
    read = spark.createDataFrame([("A", "B", "A", 3), ("A", "C", "A", 3), ("A", "C", "C", 4), ("B", "A", "B", 4), ("C", "A", "B", 1), ("C", "A", "C", 1)],
                                 "train_symbol string, test_symbol string, _from string, bits int")
    pairs = read.select("train_symbol", "test_symbol").distinct()
    got = {(r["train_symbol"], r["test_symbol"]): r["status"] for r in provenance.transfer_protocol(read, pairs).collect()}
    assert got == {("A", "B"): "PASS", ("A", "C"): "FAIL", ("B", "A"): "FAIL", ("C", "A"): "FAIL"}


def test_readiness_is_counted(spark):
    tried = spark.createDataFrame([("A", "p", 0.0), ("A", "p", 1.0)], "symbol string, policy string, theta double")
    days = [("A", "p", t, d) for t in (0.0, 1.0) for d in (1, 2)]
    kind = "symbol string, policy string, theta double, day long"
    assert overfitting_readiness(tried, spark.createDataFrame(days, kind)).first()["status"] == "READY"
    for kept in (days[:3], days[:2], []):
        got = overfitting_readiness(tried, spark.createDataFrame(kept, kind)).first()
        assert got["status"].startswith("INFEASIBLE") and got["n_with_daily_returns"] == (1 if kept else 0)
    assert overfitting_readiness(tried.limit(0), spark.createDataFrame(days, kind)).first()["status"].startswith("INFEASIBLE")


def test_one_class_gaps_and_no_rows(spark):
    import pytest

    from lobwright.operators import score as M

    rows = [("train", "UP" if i % 3 else "DOWN", float(i % 7) if i % 5 else None, float("nan") if i % 4 == 0 else float(i)) for i in range(60)]
    d = spark.createDataFrame(rows + [("test", "UP", None, None)], "split string, label string, a double, b double")
    a, b = sorted(r[2] for r in rows if r[2] is not None), sorted(r[3] for r in rows if r[3] == r[3])
    mid = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert M.fit_medians(d, ("a", "b")) == {"a": mid(a), "b": mid(b)}
    filled = M.imputer(M.fit_medians(d, ("a", "b"))).transform(d.filter("split = 'test'")).first()
    assert (filled._f_a, filled._f_b) == (mid(a), mid(b))
    scored = M.score_model(d, M.train_linear(d, ("a", "b")), ("a", "b"))
    assert scored.filter("prob_down is null").count() == 0 and scored.count() == 61
    for train in (M.train_linear, M.train_trees):
        one = M.score_model(d, train(d.filter("split = 'test' or label = 'UP'"), ("a", "b")), ("a", "b"))
        assert one.select("pred_label", "prob_up", "prob_down").distinct().collect() == [("UP", 1.0, 0.0)] and one.columns == scored.columns
        with pytest.raises(ValueError):
            train(d.filter("split = 'test'"), ("a", "b"))


def counted_medians(monkeypatch):
    """From now on medians are counted, as over more rows than ``EXACT_ROWS``."""
    from functools import partial

    from lobwright.operators import score as M

    monkeypatch.setattr(M, "group_quantiles", partial(M.group_quantiles, exact_rows=0))


def gapped(spark):
    rows = [("train" if i % 4 else "test", LABELS[(i * i) % 3 % 2 * 2], float(i % 7) if i % 5 else None, float("nan") if i % 6 == 0 else i % 11 - i % 3 / 2) for i in range(80)]
    return spark.createDataFrame(rows, "split string, label string, a double, b double")


def scores(df, train):
    from lobwright.operators import score as M

    return sorted(map(str, M.score_model(df, train(df, ("a", "b")), ("a", "b")).select("split", "label", "a", "b", "pred_label", F.round("prob_down", 9), F.round("prob_up", 9)).collect()))


def test_linear_model_where_medians_are_counted(spark, monkeypatch):
    from lobwright.operators import score as M

    df = gapped(spark)
    want = scores(df, M.train_linear)
    counted_medians(monkeypatch)
    assert scores(df, M.train_linear) == want


def test_medians_of_more_rows_than_a_task_should_hold(spark):
    from lobwright.operators import score as M

    df = spark.range(250_003).selectExpr("'train' as split", "if(id < 250001, double(id), null) as a", "if(id = 250002, double('NaN'), -0.5 * id) as b")
    assert M.fit_medians(df, ("a", "b")) == {"a": 125_000.0, "b": -62_500.25}


def test_trees_where_medians_are_counted(spark, monkeypatch):
    from lobwright.operators import score as M

    df = gapped(spark)
    want = scores(df, M.train_trees)
    counted_medians(monkeypatch)
    assert scores(df, M.train_trees) == want


def test_boosted_query_trains_all_rounds(spark, sf, monkeypatch):
    import inspect

    import __spark_entry__ as entry
    from lobwright.operators import score as M

    asked, train = [], M.train_boosted

    def short(*args, **named):
        given = inspect.signature(train).bind(*args, **named)
        given.apply_defaults()
        asked.append((given.arguments["rounds"], given.arguments["depth"]))
        given.arguments["rounds"] = 1
        return train(*given.args, **given.kwargs)

    monkeypatch.setattr(M, "train_boosted", short)
    assert entry.queries()["m4b_boosted_training"](spark, sf).count() > 0
    assert asked == [(150, 5)]


def test_boosted_classes_are_trees_of_their_own_and_scored_once(spark):
    from pyspark.ml.classification import GBTClassifier

    from lobwright.operators import score as M

    df = gapped(spark).na.fill(0.0)
    prep, models = M.train_boosted(df, ("a", "b"), rounds=4, depth=2)
    ready = prep.transform(df.filter("split = 'train'").withColumns({f"_f_{c}": F.col(c) for c in ("a", "b")}))
    for label, model in zip(LABELS, models, strict=True):
        alone = GBTClassifier(labelCol="_y", maxIter=4, maxDepth=2, stepSize=0.05, subsamplingRate=0.9, seed=7).fit(ready.withColumn("_y", (F.col("label") == label).cast("double")))
        assert model.toDebugString.split("\n", 1)[1] == alone.toDebugString.split("\n", 1)[1] and model.getNumTrees == 4
    scored = M.score_boosted(df, (prep, models), ("a", "b"))
    assert scored.columns == [*df.columns, "prob_down", "prob_flat", "prob_up", "pred_label"]
    assert scored.filter("abs(prob_down + prob_flat + prob_up - 1) > 1e-9").count() == 0 and scored.count() == 80
    plan = scored.filter("pred_label <> 'FLAT'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and not any("Filter" in line and "UDF" in line for line in plan.splitlines())
