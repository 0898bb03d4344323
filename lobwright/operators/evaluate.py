"""Classification metrics, calibration, and distribution drift."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobwright.functions.scalars import no_nan, safe_ratio
from lobwright.operators.labels import LABELS
from lobwright.operators.quantiles import group_quantiles
from lobwright.operators.regimes import UNKNOWN, share_within

# Features whose distribution is compared between symbols and splits.
DRIFT_FEATURES = (
    "mid_price", "spread", "rel_spread", "top_of_book_depth", "total_depth_10", "realized_vol_20",
    "realized_vol_100", "vol_score", "abs_future_ret_h",
)


def confusion_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Long confusion counts; pairs outside the three classes are left out."""
    known = F.col("label").isin(*LABELS) & F.col("pred_label").isin(*LABELS)
    return df.filter(known).groupBy(*by, "label", "pred_label").agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame, by: list[str]) -> DataFrame:
    """All nine cells of every group, zeros included."""
    cells = [
        F.struct(
            F.lit(a).alias("label"),
            F.lit(p).alias("pred_label"),
            F.coalesce(F.sum(F.when((F.col("label") == a) & (F.col("pred_label") == p), F.col("n"))), F.lit(0)).alias("n"),
        )
        for a in LABELS
        for p in LABELS
    ]
    packed = counts.groupBy(*by).agg(F.array(*cells).alias("_c")) if by else counts.agg(F.array(*cells).alias("_c"))
    return packed.select(*by, F.explode("_c").alias("_e")).select(*by, "_e.*")


def _zero_safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(0.0))


def metrics_from_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, macro and weighted F1, balanced accuracy and MCC.  Averages always run over the three classes."""
    n = F.col("n").cast("double")
    sums = {"_t": F.sum(n)}
    for c in LABELS:
        sums[f"_tp_{c}"] = F.coalesce(F.sum(F.when((F.col("label") == c) & (F.col("pred_label") == c), n)), F.lit(0.0))
        sums[f"_s_{c}"] = F.coalesce(F.sum(F.when(F.col("label") == c, n)), F.lit(0.0))
        sums[f"_p_{c}"] = F.coalesce(F.sum(F.when(F.col("pred_label") == c, n)), F.lit(0.0))
    aggs = [c.alias(k) for k, c in sums.items()]
    m = counts.groupBy(*by).agg(*aggs) if by else counts.agg(*aggs)
    t = F.col("_t")
    tp, s, p = ([F.col(f"_{k}_{c}") for c in LABELS] for k in ("tp", "s", "p"))
    hits = reduce(add, tp)
    recall = [_zero_safe(a, b) for a, b in zip(tp, s)]
    precision = [_zero_safe(a, b) for a, b in zip(tp, p)]
    f1 = [_zero_safe(2.0 * a * b, a + b) for a, b in zip(precision, recall)]
    k = float(len(LABELS))
    cov = hits * t - reduce(add, [a * b for a, b in zip(s, p)])
    var_p = t * t - reduce(add, [x * x for x in p])
    var_s = t * t - reduce(add, [x * x for x in s])
    return m.select(
        *by,
        t.cast("long").alias("n_rows"),
        (hits / t).alias("accuracy"),
        (reduce(add, f1) / k).alias("macro_f1"),
        (reduce(add, [a * b for a, b in zip(f1, s)]) / t).alias("weighted_f1"),
        (reduce(add, recall) / k).alias("balanced_accuracy"),
        _zero_safe(cov, F.sqrt(var_p * var_s)).alias("mcc"),
    )


def classification_by_regime(df: DataFrame, by: list[str]) -> DataFrame:
    """Per-regime and overall metrics; the rows are scanned once, the counts aggregated twice."""
    counts = confusion_counts(df, [*by, "regime"])
    regime = metrics_from_counts(counts, [*by, "regime"]).withColumn("is_total", F.lit(False))
    total = metrics_from_counts(counts, by).withColumns({"regime": F.lit(None).cast("string"), "is_total": F.lit(True)})
    return regime.unionByName(total)


def calibration(df: DataFrame, by: list[str], bins: int = 10, split: str = "test") -> DataFrame:
    """Brier score, mean confidence, accuracy and expected calibration error, from one aggregation per bin."""
    p = {c: F.col(f"prob_{c.lower()}") for c in LABELS}
    conf = F.greatest(*p.values())
    brier = reduce(add, [F.pow(p[c] - (F.col("label") == c).cast("double"), F.lit(2.0)) for c in LABELS])
    rows = df.filter(F.col("split") == split).select(
        *by,
        conf.alias("_conf"),
        brier.alias("_brier"),
        (F.col("label") == F.col("pred_label")).cast("double").alias("_hit"),
        F.least(F.floor(F.round(conf * bins, 9)), F.lit(bins - 1)).cast("long").alias("confidence_bin"),
    )
    per_bin = rows.groupBy(*by, "confidence_bin").agg(
        F.count("*").alias("n"), F.sum("_conf").alias("c"), F.sum("_hit").alias("h"), F.sum("_brier").alias("b")
    )
    n = F.sum("n")
    return per_bin.groupBy(*by).agg(
        n.alias("n_rows"),
        (F.sum("b") / n).alias("brier_score"),
        (F.sum("c") / n).alias("mean_confidence"),
        (F.sum("h") / n).alias("accuracy"),
        (F.sum(F.abs(F.col("h") - F.col("c"))) / n).alias("ece"),
    )


def drift_frame(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "top_of_book_depth": F.col("bids")[0]["size"] + F.col("asks")[0]["size"],
            "abs_future_ret_h": F.abs("future_ret_h"),
        }
    )


def distribution_stats(df: DataFrame, by: list[str], features=DRIFT_FEATURES) -> DataFrame:
    """Mean, population deviation and quantiles per group and feature, long form; infinite values are dropped.

    Features stay side by side until they are one row per group; only then are they turned into rows.
    """
    wide = df.select(*by, *[no_nan(F.col(f).cast("double")).alias(f) for f in features])
    levels = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    moments = wide.groupBy(*by).agg(*[
        m for f in features for m in (F.count(f).alias(f"n_{f}"), F.avg(f).alias(f"mean_{f}"), F.stddev_pop(f).alias(f"std_{f}"))])
    q = group_quantiles(wide, by, {f"{n}_{f}": (F.col(f), at) for f in features for n, at in levels.items()})
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n_rows"), *[
        F.col(f"{n}_{f}").alias(n) for n in ("mean", "std", *levels)]) for f in features])
    return moments.join(q, by).select(*by, F.explode(each).alias("_e")).select(*by, "_e.*").filter("n_rows > 0")


def pair_ratios(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """other / base for mean and median per ordered pair of symbols (train_symbol, test_symbol), split and feature."""
    side = lambda name, p: stats.select(
        F.col("symbol").alias(name), "split", "feature", F.col("mean").alias(f"{p}m"), F.col("median").alias(f"{p}d"))
    named = pairs.select(F.col("train_symbol").alias("base_symbol"), F.col("test_symbol").alias("other_symbol"))
    return named.join(side("base_symbol", "b"), "base_symbol").join(side("other_symbol", "o"), ["other_symbol", "split", "feature"]).select(
        "base_symbol",
        "other_symbol",
        "split",
        "feature",
        safe_ratio(F.col("om"), F.col("bm")).alias("mean_ratio"),
        safe_ratio(F.col("od"), F.col("bd")).alias("median_ratio"),
    )


def transfer_drift(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Target test against source train, per direction and feature."""
    src = stats.filter(F.col("split") == "train").select(
        F.col("symbol").alias("train_symbol"), "feature", F.col("mean").alias("source_mean"), F.col("median").alias("source_median")
    )
    tgt = stats.filter(F.col("split") == "test").select(
        F.col("symbol").alias("test_symbol"), "feature", F.col("mean").alias("target_mean"), F.col("median").alias("target_median")
    )
    return (
        pairs.join(src, "train_symbol")
        .join(tgt, ["test_symbol", "feature"])
        .withColumns(
            {
                "mean_ratio": safe_ratio(F.col("target_mean"), F.col("source_mean")),
                "median_ratio": safe_ratio(F.col("target_median"), F.col("source_median")),
            }
        )
    )


def balance(df: DataFrame, value: str, scope: str = "within_asset") -> DataFrame:
    counts = df.groupBy("symbol", "split", value).agg(F.count("*").alias("n_rows"))
    return share_within(counts, ["symbol", "split"], share="share").withColumn("scope", F.lit(scope))


def balance_by_direction(df: DataFrame, value: str, pairs: DataFrame, scope: str = "asset_heldout_target_test", split: str = "test") -> DataFrame:
    """The balance of what each direction is judged on: the target's rows of ``split``, with the direction it stands for.

    ``pairs`` (train_symbol, test_symbol) are joined to the counts, never to the rows.
    """
    target = balance(df.filter(F.col("split") == split), value, scope).join(pairs.withColumnRenamed("test_symbol", "symbol"), "symbol")
    return target.withColumn("direction", F.concat_ws(">", "train_symbol", "symbol")).drop("train_symbol")


def transfer_table(labels: DataFrame, regimes: DataFrame, calib: DataFrame, pnl: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per direction: label mix, UNKNOWN share and top regime of source train and target test, the target's
    calibration and both policies' PnL on it."""

    def side(symbol_col: str, split: str, prefix: str) -> DataFrame:
        lab = labels.filter(F.col("split") == split).groupBy("symbol").agg(
            *[
                F.coalesce(F.sum(F.when(F.col("label") == c, F.col("share"))), F.lit(0.0)).alias(f"{prefix}_{c.lower()}_share")
                for c in LABELS
            ]
        )
        known = F.col("regime") != UNKNOWN
        reg = regimes.filter(F.col("split") == split).groupBy("symbol").agg(
            F.coalesce(F.sum(F.when(~known, F.col("share"))), F.lit(0.0)).alias(f"{prefix}_unknown_share"),
            F.max(F.when(known, F.col("n_rows"))).alias("_m"),
        )
        top = (
            regimes.filter((F.col("split") == split) & known)
            .join(reg.select("symbol", "_m"), "symbol")
            .filter(F.col("n_rows") == F.col("_m"))
            .groupBy("symbol")
            .agg(F.min("regime").alias(f"{prefix}_top_regime"))
        )
        return lab.join(reg.drop("_m"), "symbol", "left").join(top, "symbol", "left").withColumnRenamed("symbol", symbol_col)

    money = pnl.groupBy("symbol").agg(
        *[F.sum(F.when(F.col("policy") == p, F.col("net_pnl"))).alias(f"{p}_net_pnl") for p in ("cost_aware_threshold", "risk_gate")]
    ).withColumnRenamed("symbol", "test_symbol")
    return (
        pairs.join(side("train_symbol", "train", "source_train"), "train_symbol", "left")
        .join(side("test_symbol", "test", "target_test"), "test_symbol", "left")
        .join(calib.withColumnRenamed("symbol", "test_symbol"), "test_symbol", "left")
        .join(money, "test_symbol", "left")
        .withColumn("gate_loss_reduction", F.col("risk_gate_net_pnl") - F.col("cost_aware_threshold_net_pnl"))
    )
