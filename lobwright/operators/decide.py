"""From class probabilities to actions: -1, 0 or +1 per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobwright.functions.scalars import KEYS

# Gate coefficients and regime penalties.
GATE = {"lambda_latency": 0.25, "lambda_liquidity": 0.25, "lambda_adverse": 0.25, "lambda_regime": 0.15, "theta_edge": 0.0}
REGIME_PENALTY = {
    "LIQUIDITY_DROUGHT": 1.0,
    "VOLATILE_ILLIQUID": 0.75,
    "MOMENTUM_TOXIC": 0.5,
    "CHOPPY_MEAN_REVERTING": 0.25,
}
GATE_OFF = {"no-latency-risk": "lambda_latency", "no-liquidity-risk": "lambda_liquidity",
            "no-adverse-risk": "lambda_adverse", "no-regime-penalty": "lambda_regime"}
DIGITS = 12


def _signed(long: Column, short: Column) -> Column:
    return F.when(long & ~short, F.lit(1)).when(short & ~long, F.lit(-1)).otherwise(F.lit(0)).cast("tinyint")


def with_expected_edge(df: DataFrame, class_means: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Probability-weighted class return; ``class_means`` has one row per symbol."""
    edge = (
        F.col("prob_up") * F.col("mean_up")
        + F.col("prob_flat") * F.col("mean_flat")
        + F.col("prob_down") * F.col("mean_down")
    )
    return df.join(class_means, list(keys)).withColumn("estimated_edge", edge).drop("mean_up", "mean_flat", "mean_down")


def naive_action(theta: Column) -> Column:
    up, down = F.round(F.col("prob_up"), DIGITS), F.round(F.col("prob_down"), DIGITS)
    return _signed(up > theta, down > theta)


def estimated_cost(fee_bps: Column | None = None) -> Column:
    return F.col("rel_spread") + (F.col("label_fee_bps") if fee_bps is None else fee_bps) / F.lit(10000.0)


def beyond(edge: Column, required: Column) -> Column:
    """+1 above ``required``, -1 below its negative; equality is no trade."""
    e, r = F.round(edge, DIGITS), F.round(required, DIGITS)
    return F.when(e > r, F.lit(1)).when(e < -r, F.lit(-1)).otherwise(F.lit(0)).cast("tinyint")


def cost_action(theta: Column) -> Column:
    return beyond(F.col("estimated_edge"), estimated_cost() + theta)


def regime_penalty() -> Column:
    expr = None
    for name, value in REGIME_PENALTY.items():
        expr = F.when(F.col("regime") == name, value) if expr is None else expr.when(F.col("regime") == name, value)
    return expr.otherwise(F.lit(0.0))


def gate_diagnostics(df: DataFrame, fee_bps: float = 1.0) -> DataFrame:
    """The risk terms of the gate, before weighting."""
    floor = F.lit(0.0)
    return df.withColumns(
        {
            "estimated_cost": estimated_cost(F.lit(float(fee_bps))),
            "latency_risk": F.abs(F.col("latency_sensitivity_score")),
            "liquidity_risk": F.greatest(F.col("liquidity_drought_score"), floor),
            "adverse_risk": F.greatest(F.col("adverse_selection_score"), floor),
            "regime_risk": regime_penalty(),
        }
    )


def required_edge(config: dict[str, float] | None = None, theta: Column | None = None) -> Column:
    c = {**GATE, **(config or {})}
    return (
        F.col("estimated_cost")
        + F.lit(c["lambda_latency"]) * F.col("latency_risk")
        + F.lit(c["lambda_liquidity"]) * F.col("liquidity_risk")
        + F.lit(c["lambda_adverse"]) * F.col("adverse_risk")
        + F.lit(c["lambda_regime"]) * F.col("regime_risk")
        + (F.lit(float(c["theta_edge"])) if theta is None else theta)
    )


def gate_action(config: dict[str, float] | None = None, theta: Column | None = None) -> Column:
    return beyond(F.col("estimated_edge"), required_edge(config, theta))


def gate_variants(no_cost_gate: bool = False) -> dict[str, dict[str, float]]:
    out = {"full": {}, **{name: {coef: 0.0} for name, coef in GATE_OFF.items()}}
    if no_cost_gate:
        out["no-cost-gate"] = {"theta_edge": -1.0}
    return out


def imbalance_action(threshold: float = 0.35) -> Column:
    x = F.col("depth_imbalance_10")
    return _signed(x > threshold, x < -threshold)


def small_gate_score() -> Column:
    """Signed excess of the edge over cost and risk, else 0."""
    penalised = F.col("regime").isin("LIQUIDITY_DROUGHT", "VOLATILE_ILLIQUID").cast("double")
    risk = (
        F.lit(0.25) * F.abs(F.col("realized_vol_20"))
        + F.lit(0.25) * F.col("rel_spread")
        + F.lit(0.15) * penalised * F.col("rel_spread")
    )
    need = F.col("cost_threshold_t") + risk
    e = F.col("estimated_edge")
    return F.when(e > need, e - need).when(e < -need, e + need).otherwise(F.lit(0.0))


def small_naive_action(cut: float = 0.45) -> Column:
    up, down = F.round(F.col("prob_up"), DIGITS), F.round(F.col("prob_down"), DIGITS)
    return F.when((up >= cut) & (up >= down), F.lit(1)).when(down >= cut, F.lit(-1)).otherwise(F.lit(0)).cast("tinyint")
