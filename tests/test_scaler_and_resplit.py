import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import book
from lobwright.operators.features import level_vector
from lobwright.operators.score import fit_vector_scaler
from lobwright.operators.splits import write_resplit


def test_vector_scaler_as_numpy(spark):
    """Every cell, over all train rows; a cell that never changes is divided by the square root of the floor."""
    rng = np.random.default_rng(3)
    bids = {i: [(99.0 - k - rng.random(), float(rng.integers(1, 50))) for k in range(20)] for i in range(300)}
    d = book(spark, 300, bids=bids).withColumn("split", F.when(F.col("event_idx") < 200, "train").otherwise("test"))
    raw = np.array([r.v for r in d.orderBy("event_idx").select(level_vector(10).alias("v")).collect()], dtype=np.float64)
    scaler = fit_vector_scaler(d, level_vector(10), 40)
    fit = scaler.first().scaler
    std = np.sqrt(np.maximum(raw[:200].var(axis=0), 1e-12))
    assert np.allclose(fit.mean, raw[:200].mean(axis=0), rtol=1e-12) and np.allclose(fit.std, std, rtol=1e-9)
    assert 1e-6 in np.round(fit.std, 12) and (np.array(fit.std) > 1e-6).sum() >= 20
    scaled = d.join(scaler, ["exchange", "symbol"]).orderBy("event_idx").select(level_vector(10, "scaler").alias("v")).collect()
    assert np.allclose([r.v for r in scaled], (raw - raw[:200].mean(axis=0)) / std, rtol=1e-4, atol=1e-4)
    with pytest.raises(ValueError):
        fit_vector_scaler(d, level_vector(10), 40, split="valid")


def labelled(spark, n, horizon):
    d = book(spark, n).select("exchange", "symbol", "event_idx", "event_us")
    two = d.unionByName(d.filter(f"event_idx < {n // 2}").withColumn("symbol", F.lit("T")))
    return two.withColumns({"split": F.lit("old"), "pred_label": F.lit("UP"), "label_horizon_events": F.lit(horizon)})


def test_resplit_is_written_checked_and_read_back(spark, tmp_path):
    path = str(tmp_path / "again")
    got = write_resplit(labelled(spark, 100, 5), path, 0.5, 0.3, 5)
    assert {(r.symbol, r.split): r["count"] for r in got.groupBy("symbol", "split").count().collect()} == {
        ("S", "train"): 45, ("S", "valid"): 25, ("S", "test"): 20, ("T", "train"): 20, ("T", "valid"): 10, ("T", "test"): 10}
    assert "pred_label" not in got.columns and not os.path.exists(path + "_unchecked")
    assert write_resplit(labelled(spark, 60, 5), path, 0.5, 0.3, 5).count() == 70  # 90 rows, five of them purged at each of four boundaries
    assert write_resplit(labelled(spark, 100, 5).limit(0), path, 0.5, 0.3, 5).count() == 0


def test_a_leaking_or_incomplete_split_is_not_published(spark, tmp_path):
    path = str(tmp_path / "again")
    with pytest.raises(ValueError, match="reach into the next split"):
        write_resplit(labelled(spark, 100, 6), path, 0.5, 0.3, 5)
    gap = labelled(spark, 100, 5).filter("event_idx <> 98").withColumn("event_idx", F.when(F.col("event_idx") == 99, 46).otherwise(F.col("event_idx")))
    with pytest.raises(ValueError, match="rows, not"):
        write_resplit(gap, path, 0.5, 0.3, 5)
    with pytest.raises(ValueError, match="no split"):
        write_resplit(labelled(spark, 100, 5), path, 0.8, 0.3, 5)
    assert os.listdir(tmp_path) == []
