"""Joins, unions and upserts on result tables, and the model-selection ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobwright.operators import provenance

# Model families by name, in order of precedence.
FAMILIES = (
    ("starts", "asset_", "asset_heldout_streaming_sgd"),
    ("contains", "xgboost", "xgboost_gpu_tabular"),
    ("contains", "tcn", "temporal_tcn"),
    ("contains", "deeplob", "deeplob_cnn_lstm"),
    ("contains", "transformer", "lob_transformer_lite"),
    ("contains", "sgd", "streaming_sgd_tabular"),
)


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c not in keys})


def join_results(base: DataFrame, parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Left joins of result tables, each with its own column prefix."""
    return reduce(lambda d, p: d.join(prefixed(p[1], p[0], keys), keys, "left"), parts.items(), base)


def policy_columns(pnl: DataFrame, keys: list[str], policies, values=("net_pnl", "n_trades")) -> DataFrame:
    """One row per key with a column per policy and value: one aggregation instead of a join per policy."""
    aggs = [
        F.max(F.when(F.col("policy") == p, F.col(v))).alias(f"{p}_{v}") for p in policies for v in values
    ]
    return pnl.groupBy(*keys).agg(*aggs)


def first_of(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources; a key present in several is taken from the first."""
    tagged = [d.withColumn("_rank", F.lit(i)) for i, d in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    w = Window.partitionBy(*keys).orderBy("_rank")
    return union.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_rank")


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Adds the position of ``column`` in a custom order; values not listed come last."""
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    return df.withColumn("sort_order", F.when(pos > 0, pos).otherwise(F.lit(len(order) + 1).cast("long")))


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``fresh`` replaces the rows of ``existing`` with the same key."""
    return existing.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def comparison(baselines: DataFrame, previous: DataFrame, fresh: DataFrame, key: str = "model") -> DataFrame:
    """Baselines, earlier rows that are not superseded, and the new row; the latest of a model wins."""
    kept = previous.join(fresh.select(key).distinct(), key, "left_anti")
    base = baselines.join(kept.select(key).unionByName(fresh.select(key)).distinct(), key, "left_anti")
    return base.unionByName(kept, allowMissingColumns=True).unionByName(fresh, allowMissingColumns=True)


def first_available(base: DataFrame, tables: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """Values from the first table that has the key, with the number of that table."""
    out = base
    for i, t in enumerate(tables):
        out = out.join(t.select(*keys, *[F.col(v).alias(f"_{v}_{i}") for v in values], F.lit(i).alias(f"_i_{i}")), keys, "left")
    pick = {v: F.coalesce(*[F.col(f"_{v}_{i}") for i in range(len(tables))]) for v in values}
    pick["source_no"] = F.coalesce(*[F.col(f"_i_{i}") for i in range(len(tables))])
    return out.withColumns(pick).select(*base.columns, *values, "source_no")


def canonical(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each canonical column from the first of its aliases that is there."""
    cols = []
    for name, options in aliases.items():
        have = [F.col(o) for o in options if o in df.columns]
        cols.append((F.coalesce(*have) if have else F.lit(None)).alias(name))
    return df.select(*cols)


def model_family(model: Column) -> Column:
    name = F.lower(model)
    expr = None
    for how, text, family in FAMILIES:
        test = name.startswith(text) if how == "starts" else name.contains(text)
        expr = F.when(test, family) if expr is None else expr.when(test, family)
    return expr.otherwise("unknown")


def selection_source(df: DataFrame) -> Column:
    """The split a threshold was chosen on: what ``tuned_bits`` say was read, else ``tuning_split``, else ``split``."""
    if "tuned_bits" in df.columns:
        return provenance.split_names(F.col("tuned_bits"))
    split = F.coalesce(F.nullif(F.col("split"), F.lit("")), F.lit("unknown"))
    return F.coalesce(F.nullif(F.col("tuning_split"), F.lit("")), split) if "tuning_split" in df.columns else split


def selection_status(df: DataFrame) -> Column:
    if "read_bits" in df.columns:
        return provenance.selection_status(F.col("read_bits"))
    uses_test = F.lower(selection_source(df)).contains("test") | (F.lower(F.coalesce("split", F.lit(""))) == "test")
    return F.when(uses_test, "FAIL_TEST_SELECTION").otherwise("PASS_VALIDATION_ONLY")


def selection_ledger(tuning: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Per model and policy the selected threshold (else the best net PnL), its audit status and its test result."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.col("selected").cast("int")), F.desc(F.round("net_pnl", 9)), "theta")
    picked = (
        tuning.withColumns({"selection_source": selection_source(tuning), "selection_audit_status": selection_status(tuning)})
        .withColumn("_r", F.row_number().over(w))
        .filter("_r = 1")
    )
    valid = F.to_json(F.struct(F.round("net_pnl", 6).cast("decimal(20,6)").alias("net_pnl"), "n_trades", "n_trade_days", "split"))
    test = prefixed(results, "test", keys)
    return picked.withColumn("validation_result", valid).drop("_r").join(test, keys, "left")


def candidate_counts(tuning: DataFrame, keys: list[str]) -> DataFrame:
    """How many thresholds were tried and selected, from which splits, and which ones."""
    t = tuning.withColumns({"_src": selection_source(tuning), "_status": selection_status(tuning)})
    chosen = F.col("selected")
    return t.groupBy(*keys).agg(
        F.count("*").alias("n_candidates"),
        F.count_if(chosen).alias("n_selected"),
        F.array_join(F.sort_array(F.collect_set(F.when(chosen, F.col("_src")))), ",").alias("selection_sources"),
        F.array_join(
            F.transform(F.sort_array(F.collect_set(F.when(chosen, F.round("theta", 9)))), lambda x: F.format_number(x, 9)), ","
        ).alias("selected_thresholds"),
        F.when(F.count_if(chosen & (F.col("_status") != "PASS_VALIDATION_ONLY")) > 0, "FAIL_TEST_SELECTION")
        .otherwise("PASS_VALIDATION_ONLY")
        .alias("selection_audit_status"),
    )


def overfitting_readiness(candidates: DataFrame, daily: DataFrame, least_days: int = 2) -> DataFrame:
    """Whether an overfitting test is possible: ``daily`` (symbol, policy, theta, day) must hold returns of every candidate
    (symbol, policy, theta) on at least ``least_days`` days."""
    by = ["symbol", "policy", "theta"]
    covered = daily.groupBy(*by).agg(F.count_distinct("day").alias("_days")).filter(F.col("_days") >= least_days)
    counts = candidates.join(covered, by, "left").agg(
        F.count_distinct("symbol", "policy").alias("n_candidate_groups"), F.count("*").alias("n_threshold_candidates"), F.count("_days").alias("n_with_daily_returns"))
    ready = (F.col("n_with_daily_returns") == F.col("n_threshold_candidates")) & (F.col("n_threshold_candidates") > 0)
    return counts.withColumn("status", F.when(ready, "READY").otherwise("INFEASIBLE_FROM_CURRENT_SAVED_ARTIFACTS"))


def final_selection(validation: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """The policy each model would use by validation, its test result, and whether the test-best policy differs."""
    best_valid = validation.groupBy(*keys).agg(
        F.expr("max_by(policy, struct(round(net_pnl, 9), policy))").alias("best_validation_policy")
    )
    best_test = test.groupBy(*keys).agg(
        F.expr("max_by(policy, struct(round(net_pnl, 9), policy))").alias("test_best_policy")
    )
    result = test.withColumnRenamed("policy", "best_validation_policy").select(
        *keys, "best_validation_policy", F.col("net_pnl").alias("test_net_pnl"), F.col("n_trades").alias("test_n_trades")
    )
    return (
        best_valid.join(best_test, keys, "left")
        .join(result, [*keys, "best_validation_policy"], "left")
        .withColumn("test_best_differs", F.coalesce(F.col("best_validation_policy") != F.col("test_best_policy"), F.lit(False)))
    )
