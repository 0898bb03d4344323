"""Threshold grids, policy tuning on the validation split, and evaluation of the winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobwright.functions.scalars import KEYS, hash_unit
from lobwright.operators import decide
from lobwright.operators.fills import Execution, charge, cool_down, round_trips, summarize
from lobwright.operators.quantiles import group_quantiles, largest_group
from lobwright.sources.stages import per_key

# Grids.
NAIVE_GRID = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
MARGIN_QUANTILES = (0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.975, 0.99)
POLICIES = ("naive_threshold", "cost_aware_threshold", "risk_gate")


def naive_grid(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The probability thresholds to try, for every symbol present."""
    return (
        df.groupBy(*keys)
        .agg(F.lit(1).alias("_one"))
        .select(*keys, F.explode(F.array(*[F.lit(t) for t in NAIVE_GRID])).alias("theta"))
    )


def margin_grid(
    df: DataFrame, base: Column, keys: tuple[str, ...] = KEYS, quantiles=MARGIN_QUANTILES, include_zero: bool = True,
    largest: int | None = None,
) -> DataFrame:
    """Thresholds at quantiles of the positive margin of the edge over ``base``; [0] when no margin is positive."""
    margin = F.abs(F.col("estimated_edge")) - base
    m = df.select(*keys, margin.alias("_m"))
    names = [f"_q{i}" for i in range(len(quantiles))]
    wanted = {n: (F.col("_m"), v) for n, v in zip(names, quantiles)}
    q = group_quantiles(m.filter(F.col("_m") > 0), list(keys), wanted, largest=largest)
    symbols = df.groupBy(*keys).agg(F.lit(1).alias("_one")).drop("_one")
    values = F.array(*([F.lit(0.0)] if include_zero else []), *[F.round(F.col(n), 12) for n in names])
    grid = F.array_sort(F.array_distinct(F.when(F.col(names[0]).isNotNull(), values).otherwise(F.array(F.lit(0.0)))))
    return symbols.join(q, list(keys), "left").select(*keys, F.explode(grid).alias("theta"))


def policy_grid(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(symbol, policy, theta) for all three policies; ``df`` carries the edge and the gate's risk terms."""
    largest = largest_group(df.select(*keys), list(keys))
    parts = {
        "naive_threshold": naive_grid(df, keys),
        "cost_aware_threshold": margin_grid(df, decide.estimated_cost(), keys, largest=largest),
        "risk_gate": margin_grid(df, decide.required_edge(), keys, largest=largest),
    }
    out = None
    for name, grid in parts.items():
        g = grid.withColumn("policy", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out


def policy_action(policy: Column, theta: Column) -> Column:
    return (
        F.when(policy == "naive_threshold", decide.naive_action(theta))
        .when(policy == "cost_aware_threshold", decide.cost_action(theta))
        .otherwise(decide.gate_action(theta=theta))
    )


def grid_signals(df: DataFrame, grid: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per (row, side) that trades under some policy and threshold; ``members`` lists which.

    The grid travels as one small array per symbol; entries that do nothing are removed in place, so the row count
    never becomes rows x thresholds, and a row is filled once per side however many policies and thresholds share it.
    """
    packed = per_key(grid.groupBy(*keys).agg(F.collect_list(F.struct("policy", "theta")).alias("_grid")))
    narrow = [
        *keys, "event_idx", "prob_up", "prob_down", "estimated_edge", "rel_spread", "label_fee_bps", "estimated_cost",
        "latency_risk", "liquidity_risk", "adverse_risk", "regime_risk",
    ]
    acts = F.transform(
        "_grid",
        lambda g: F.struct(g["policy"].alias("policy"), g["theta"].alias("theta"), policy_action(g["policy"], g["theta"]).alias("action")),
    )
    return (
        df.select(*narrow)
        .join(packed, list(keys))
        .select(*keys, "event_idx", acts.alias("_acts"))
        .selectExpr(*keys, "event_idx", "_acts", "explode(array(1Y, -1Y)) as action")
        .selectExpr(
            *keys, "event_idx", "action",
            "transform(filter(_acts, a -> a.action = action), a -> struct(a.policy as policy, a.theta as theta)) as members",
        )
        .filter("size(members) > 0")
    )


def by_member(df: DataFrame) -> DataFrame:
    """One row per member, with ``policy`` and ``theta`` columns."""
    return df.selectExpr(*[c for c in df.columns if c != "members"], "inline(members)")


def evaluate_grid(
    df: DataFrame, grid: DataFrame, cfg: Execution = Execution(), keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Trade summary of every (symbol, policy, theta)."""
    signals = grid_signals(df, grid, keys).withColumn("side", F.col("action"))
    trips = round_trips(signals, df, cfg, by=("side",), carry=("members",), keys=keys).drop("side")
    trades = charge(cool_down(by_member(trips), cfg, ("policy", "theta"), keys), cfg.fee_bps)
    by = [*keys, "policy", "theta"]
    out = grid.join(summarize(trades, by), by, "left")
    zeros = ["n_trades", "n_trade_days"]
    money = ["gross_pnl", "net_pnl", "total_cost", "turnover", "net_pnl_per_trade", "max_drawdown"]
    return out.na.fill(0, zeros).na.fill(0.0, money)


def select_threshold(
    results: DataFrame, rows: DataFrame, min_trades: int | None = None, min_days: int = 5, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Marks the winner per (symbol, policy): enough trades and days first, then net PnL, then the smaller theta.

    When no threshold is eligible all are, which the same ordering gives.  ``rows`` is the tuning split.
    """
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    need = F.greatest(F.lit(1000), F.floor(F.lit(0.0005) * F.col("_n"))) if min_trades is None else F.lit(min_trades)
    w = Window.partitionBy(*keys, "policy").orderBy(F.desc("eligible"), F.desc(F.round("net_pnl", 9)), "theta")
    return (
        results.join(n, list(keys))
        .withColumn("eligible", (F.col("n_trades") >= need) & (F.col("n_trade_days") >= min_days))
        .withColumn("selected", F.row_number().over(w) == 1)
        .drop("_n")
    )


def tuning_record(selected: DataFrame) -> DataFrame:
    """The tuned policy with the settings it was tuned under, to be read back by the stress runs."""
    g = decide.GATE
    return selected.filter("selected").select(
        "symbol",
        "policy",
        "theta",
        *[F.lit(g[k]).alias(k) for k in ("lambda_latency", "lambda_liquidity", "lambda_adverse", "lambda_regime")],
        F.lit("fixed_singleton_grid").alias("lambda_selection"),
        F.lit("validation_positive_margin_quantiles").alias("theta_selection"),
        F.lit("max_net_pnl_with_min_trades_and_min_trade_days").alias("validation_objective"),
    )


def winner_grid(selected: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return selected.filter("selected").select(*keys, "policy", "theta")


def winner_trades(df: DataFrame, winners: DataFrame, cfg: Execution = Execution(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Trades of the selected policies on another split."""
    signals = grid_signals(df, winners, keys).withColumn("side", F.col("action"))
    trips = round_trips(signals, df, cfg, by=("side",), carry=("members",), keys=keys).drop("side")
    return charge(cool_down(by_member(trips).drop("theta"), cfg, ("policy",), keys), cfg.fee_bps)


def systematic_sample(df: DataFrame, max_rows: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every k-th row of a split, k = ceil(n / max_rows); the split is a contiguous run of ``event_idx``."""
    span = per_key(df.groupBy(*keys).agg(F.min("event_idx").alias("_first"), F.count("*").alias("_n")))
    step = F.greatest(F.ceil(F.col("_n") / F.lit(max_rows)), F.lit(1))
    return df.join(span, list(keys)).filter((F.col("event_idx") - F.col("_first")) % step == 0).drop("_first", "_n")


def hash_sample(df: DataFrame, key: Column, fraction: float, seed: int = 7) -> DataFrame:
    """A fixed pseudo-random share of rows: the same rows on every run and every cluster size."""
    return df.filter(hash_unit(F.concat(F.lit(f"{seed}:"), key.cast("string"))) <= F.lit(fraction))
