"""Chronological, held-out and walk-forward splits, with their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lobwright.functions.scalars import KEYS
from lobwright.operators.regimes import sequence_length
from lobwright.sources.stages import per_key

# Split order.
SPLITS = ("train", "valid", "test")
PREDICTION_COLUMNS = ("prob_down", "prob_flat", "prob_up", "pred_label")


def split_bounds(df: DataFrame, train: float, valid: float, keys: tuple[str, ...]) -> DataFrame:
    n = sequence_length(df, keys)
    return n.withColumns(
        {
            "_t": F.floor(F.col("n_events") * F.lit(train)).cast("long"),
            "_v": F.floor(F.col("n_events") * F.lit(train + valid)).cast("long"),
        }
    ).drop("n_events")


def chronological_split(
    df: DataFrame, train: float = 0.6, valid: float = 0.2, purge: int = 50, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """train / valid / test by position; the last ``purge`` rows before each boundary are dropped.

    A row's split depends on its index and its symbol's row count only, so there is nothing to sort.
    """
    i, t, v = F.col("event_idx"), F.col("_t"), F.col("_v")
    split = (
        F.when(i < F.greatest(t - purge, F.lit(0)), "train")
        .when((i >= t) & (i < F.greatest(v - purge, t)), "valid")
        .when(i >= v, "test")
    )
    out = df.join(split_bounds(df, train, valid, keys), list(keys)).withColumn("split", split)
    return out.filter(F.col("split").isNotNull()).drop("_t", "_v")


def resplit(df: DataFrame, train: float = 0.6, valid: float = 0.2, purge: int = 50, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Split an existing table anew; predictions of the old split are dropped with it."""
    stale = [c for c in (*PREDICTION_COLUMNS, "split") if c in df.columns]
    return chronological_split(df.drop(*stale), train, valid, purge, keys)


def write_resplit(
    df: DataFrame, path: str, train: float = 0.6, valid: float = 0.2, purge: int = 50, horizon: str = "label_horizon_events",
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """``resplit`` written to ``path`` and read back; an error, and nothing at ``path``, if it isn't what it must be.

    The pass that writes counts, as observed metrics, the rows and those whose label looks into the next split or beyond it.  The rows
    must be as many as follow from each key's length; no label may reach over a boundary; no old prediction may be left.
    """
    if not 0 < train < 1 or not 0 <= valid < 1 or train + valid >= 1 or purge < 0:
        raise ValueError(f"no split: train {train}, valid {valid}, purge {purge}")
    bounds = split_bounds(df, train, valid, keys)
    want = sequence_length(df, keys).join(bounds, list(keys)).agg(F.sum(
        F.greatest(F.col("_t") - purge, F.lit(0)) + F.greatest(F.col("_v") - purge - F.col("_t"), F.lit(0)) + F.col("n_events") - F.col("_v"))).first()[0]
    again = resplit(df, train, valid, purge, keys).join(bounds, list(keys))
    limit = F.when(F.col("split") == "train", F.col("_t")).when(F.col("split") == "valid", F.col("_v"))
    seen = Observation()
    counted = again.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("event_idx") + F.col(horizon) >= limit).alias("reaching"))
    side = f"{path.rstrip('/')}_unchecked"
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    counted.drop("_t", "_v").write.mode("overwrite").parquet(side)
    left = [c for c in PREDICTION_COLUMNS if c in again.columns]
    wrong = [f"{seen.get['rows']} rows, not {want}"] * (seen.get["rows"] != (want or 0))
    wrong += [f"{seen.get['reaching']} labels reach into the next split"] * (seen.get["reaching"] > 0) + [f"old predictions {left}"] * bool(left)
    if wrong:
        fs.delete(place(side), True)
        raise ValueError("re-split: " + "; ".join(wrong))
    fs.delete(place(path), True)
    if not fs.rename(place(side), place(path)):
        raise OSError(f"cannot rename {side} to {path}")
    return spark.read.schema(again.drop("_t", "_v").schema).parquet(path)


def regime_held_out(df: DataFrame, regime: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col("regime") == regime, "test").otherwise("train"))


def asset_pairs(df: DataFrame) -> DataFrame:
    """All ordered pairs of two different symbols.  Grows with the number of symbols, not of rows."""
    every = df.groupBy("symbol").agg(F.lit(1).alias("one")).agg(F.sort_array(F.collect_list("symbol")).alias("s"))
    source = every.select("s", F.explode("s").alias("train_symbol"))
    return source.select("train_symbol", F.explode("s").alias("test_symbol")).filter(
        F.col("train_symbol") != F.col("test_symbol")
    )


def split_manifest(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "split").agg(
        F.count("*").alias("n_rows"), F.min("event_us").alias("start_us"), F.max("event_us").alias("end_us")
    )


def split_audit(df: DataFrame, purge: int = 0) -> DataFrame:
    """Rows, span, gap to the next split that has rows, and how far labels reach over the boundary."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split"))
    agg = df.groupBy("symbol", "split").agg(
        F.count("*").alias("n_rows"),
        F.min("event_us").alias("start_us"),
        F.max("event_us").alias("end_us"),
        F.max("label_horizon_events").alias("horizon_events"),
    )
    w = Window.partitionBy("symbol").orderBy(rank)
    out = agg.withColumns({"next_split": F.lead("split").over(w), "_next": F.lead("start_us").over(w)})
    has_next = F.col("next_split").isNotNull()
    return (
        out.withColumn("boundary_gap_ms", (F.col("_next") - F.col("end_us")) / F.lit(1000.0))
        .withColumn(
            "horizon_overlap_rows",
            F.when(has_next, F.greatest(F.col("horizon_events") - purge, F.lit(0))).otherwise(F.lit(0)),
        )
        .withColumn("status", F.when(F.col("horizon_overlap_rows") == 0, "PASS").otherwise("WARN_BOUNDARY_OVERLAP"))
        .drop("_next")
    )


def walk_forward(df: DataFrame, folds: int, train_us: int, test_us: int, purge_us: int = 0) -> DataFrame:
    """Fold number and role by event time: ``folds`` windows, each shifted by ``test_us``.

    The first and the last fold of a row follow from its offset to the symbol's first event by division, so each row is
    expanded into the folds that hold it and no others.
    """
    start = per_key(df.groupBy(*KEYS).agg(F.min("event_us").alias("_t0")))
    off = F.col("event_us") - F.col("_t0")
    first = F.greatest(F.lit(0), F.expr(f"cast(ceil((_off - {train_us + test_us} + 1) / {test_us}) as int)"))
    last = F.least(F.lit(folds - 1), F.expr(f"cast(_off div {test_us} as int)"))
    fold = F.explode(F.when(first <= last, F.sequence(first, last)))
    rel = F.col("_off") - F.col("fold") * F.lit(test_us)
    role = F.when((rel >= 0) & (rel < train_us - purge_us), "train").when(
        (rel >= train_us) & (rel < train_us + test_us), "test"
    )
    return (
        df.join(start, list(KEYS))
        .withColumn("_off", off)
        .withColumn("fold", fold)
        .withColumn("split", role)
        .filter(F.col("split").isNotNull())
        .drop("_off", "_t0")
    )
