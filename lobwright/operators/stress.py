"""Stress grids over execution settings, and robustness measures of the resulting curves."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobwright.functions.scalars import KEYS
from lobwright.operators.fills import Execution, charge, round_trips, summarize
from lobwright.operators.thin import thin
from lobwright.operators.tune import by_member

# Axes and levels.
STRESS_GRID = {
    "fee_bps": (0.0, 1.0, 2.0, 5.0, 10.0),
    "latency_events": (0, 1, 5, 10),
    "spread_multiplier": (1.0, 1.5, 2.0),
    "depth_multiplier": (1.0, 0.75, 0.5),
}
FIELD = {"fee_bps": "fee_bps", "latency_events": "latency", "spread_multiplier": "spread_multiplier",
         "depth_multiplier": "depth_multiplier"}


def check_grid(grid: dict) -> dict:
    unknown = sorted(set(grid) - set(FIELD))
    if unknown:
        raise ValueError(f"unknown stress axes {unknown}")
    empty = [a for a, levels in grid.items() if not levels]
    if empty:
        raise ValueError(f"stress axes without levels {empty}")
    return {a: tuple(int(x) if a == "latency_events" else float(x) for x in grid[a]) for a in FIELD if a in grid}


def scenarios(base: Execution, grid: dict | None = None) -> list[tuple[str, float, Execution]]:
    """One axis moves at a time; everything else stays at ``base``."""
    return [
        (axis, float(level), replace(base, **{FIELD[axis]: level}))
        for axis, levels in check_grid(grid or STRESS_GRID).items()
        for level in levels
    ]


def stress_trades(
    signals: DataFrame, book: DataFrame, base: Execution = Execution(), grid: dict | None = None,
    by: tuple[str, ...] = ("policy",), keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Trades of fixed signals under every scenario, in one job.

    Fees change neither fills nor the cooldown, so scenarios that differ only in fee share their fills: fifteen cells
    need eight replays.  Only signal rows fan out; signals may carry ``members`` (policies sharing a row and side).
    """
    cells = scenarios(base, grid)
    plans: dict[tuple, list[tuple[str, float, float]]] = {}
    for axis, level, cfg in cells:
        plans.setdefault((cfg.latency, cfg.spread_multiplier, cfg.depth_multiplier), []).append((axis, level, cfg.fee_bps))
    fan = F.array(
        *[
            F.struct(
                F.lit(i).alias("plan"),
                F.lit(lat).cast("long").alias("latency"),
                F.lit(float(sm)).alias("spread_multiplier"),
                F.lit(float(dm)).alias("depth_multiplier"),
            )
            for i, (lat, sm, dm) in enumerate(plans)
        ]
    )
    shared = "members" in signals.columns
    carry = ("members",) if shared else ()
    inner = ("side",) if shared else by
    sig = signals.withColumn("side", F.col("action")) if shared else signals
    spread = sig.select(*keys, *inner, "event_idx", "action", *carry, F.explode(fan).alias("_p")).select(
        *keys, *inner, "event_idx", "action", *carry, "_p.*"
    )
    trips = round_trips(spread, book, base, by=(*inner, "plan"), carry=carry, keys=keys)
    if shared:
        trips = by_member(trips.drop("side")).drop("theta")
    kept = thin(trips, [*keys, *by, "plan"], "signal_index", base.cooldown)
    cases = None
    for i, members in enumerate(plans.values()):
        arr = F.array(
            *[
                F.struct(F.lit(a).alias("stress_axis"), F.lit(lv).alias("stress_level"), F.lit(fee).alias("fee_bps"))
                for a, lv, fee in members
            ]
        )
        cases = F.when(F.col("plan") == i, arr) if cases is None else cases.when(F.col("plan") == i, arr)
    out = kept.withColumn("_case", F.explode(cases)).select("*", "_case.*").drop("_case", "plan")
    return charge(out, F.col("fee_bps"))


def stress_summary(trades: DataFrame, by: tuple[str, ...] = ("symbol", "policy")) -> DataFrame:
    return summarize(trades, [*by, "stress_axis", "stress_level"])


def robustness_auc(curves: DataFrame, by: list[str], level: str = "stress_level", value: str = "net_pnl") -> DataFrame:
    """Trapezoid area under value over level, divided by the level range; NULL with fewer than two levels."""
    w = Window.partitionBy(*by).orderBy(level)
    d = curves.withColumns({"_x": F.lag(level).over(w), "_y": F.lag(value).over(w)})
    area = F.sum((F.col(value) + F.col("_y")) / 2.0 * (F.col(level) - F.col("_x")))
    span = F.max(level) - F.min(level)
    return d.groupBy(*by).agg(F.when(span > 0, F.try_divide(area, F.greatest(span, F.lit(1e-9)))).alias("robustness_auc"))


def latency_half_life(curves: DataFrame, by: list[str], level: str = "stress_level", value: str = "net_pnl") -> DataFrame:
    """First level whose value is at most half of the first level's; NULL without a positive start or such a level."""
    base = curves.groupBy(*by).agg(F.min_by(value, level).alias("_base"))
    half = F.col("_base") > 0
    return (
        curves.join(base, by)
        .groupBy(*by)
        .agg(F.min(F.when(half & (F.col(value) <= 0.5 * F.col("_base")), F.col(level))).alias("latency_half_life"))
    )


def regime_spread(by_regime: DataFrame, by: list[str], value: str = "net_pnl") -> DataFrame:
    """Worst regime, best-to-worst gap and mean over regimes."""
    return by_regime.groupBy(*by).agg(
        F.min(value).alias("worst_regime_return"),
        (F.max(value) - F.min(value)).alias("regime_gap"),
        F.avg(value).alias("mean_regime_return"),
    )


def gate_wins(spread: DataFrame, by: list[str], gate: str = "risk_gate") -> DataFrame:
    """Whether the gate's worst regime and regime gap are at least as good as the best baseline's."""
    is_gate = F.col("policy") == gate
    agg = spread.groupBy(*by).agg(
        F.max(F.when(is_gate, F.col("worst_regime_return"))).alias("gate_worst"),
        F.max(F.when(~is_gate, F.col("worst_regime_return"))).alias("baseline_worst"),
        F.min(F.when(is_gate, F.col("regime_gap"))).alias("gate_gap"),
        F.min(F.when(~is_gate, F.col("regime_gap"))).alias("baseline_gap"),
    )
    return agg.withColumns(
        {
            "comparable": F.col("gate_worst").isNotNull() & F.col("baseline_worst").isNotNull(),
            "wins_worst_regime": F.coalesce(F.round("gate_worst", 9) >= F.round("baseline_worst", 9), F.lit(False)),
            "wins_regime_gap": F.coalesce(F.round("gate_gap", 9) <= F.round("baseline_gap", 9), F.lit(False)),
        }
    )


def degradation(curves: DataFrame, by: list[str], level: str = "stress_level", value: str = "net_pnl") -> DataFrame:
    """Whether the value at the last level is below the value at the first."""
    return curves.groupBy(*by).agg(
        F.count("*").alias("n_levels"), F.min_by(value, level).alias("first_value"), F.max_by(value, level).alias("last_value")
    ).withColumn("degraded", (F.col("n_levels") >= 2) & (F.col("last_value") < F.col("first_value")))
