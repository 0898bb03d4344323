"""An acceptance bar over result tables: one status per criterion and group.

Every rule is one aggregation of a small result table to a row per group: PASS, PARTIAL or FAIL, with the number of rows it saw and
the figure it decided on.  A group that a table says nothing about has FAIL there.  Figures are compared at nine places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bars.
LEAST_REGIMES = 3
LEAST_SPREAD = 0.03
LEAST_AXES = 3
LEAST_RESAMPLES = 1000

#: Criteria in the order of their numbers.
CRITERIA = ("regime_variation", "edge_lost_to_costs", "stress_degradation", "worst_regime", "regime_gap", "stress_axes", "interval_support")


def _status(passed: Column, otherwise: str | Column = "PARTIAL") -> Column:
    return F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise(otherwise).alias("status")


def _any(condition: Column) -> Column:
    return F.coalesce(F.max(condition), F.lit(False))


def regime_variation(metrics: DataFrame, by: list[str], least_regimes: int = LEAST_REGIMES, least_spread: float = LEAST_SPREAD) -> DataFrame:
    """``metrics`` (regime, macro_f1): PASS with enough regimes and a macro-F1 that differs enough between best and worst."""
    spread = F.round(F.max("macro_f1") - F.min("macro_f1"), 9)
    return metrics.groupBy(*by).agg(
        _status((F.count_distinct("regime") >= least_regimes) & (spread >= least_spread)),
        F.count_distinct("regime").alias("n"), F.coalesce(spread, F.lit(0.0)).alias("figure"))


def edge_lost(tuned: DataFrame, plain: DataFrame, by: list[str]) -> DataFrame:
    """(gross_pnl, net_pnl) of tuned and of untuned replays: PASS if costs turn a tuned gain into a loss, or an untuned replay loses."""
    rows = tuned.select(*by, "gross_pnl", "net_pnl", F.lit(True).alias("is_tuned")).unionByName(plain.select(*by, "gross_pnl", "net_pnl", F.lit(False).alias("is_tuned")))
    loses = F.round("net_pnl", 9) < 0
    lost = loses & (~F.col("is_tuned") | (F.round("gross_pnl", 9) > 0))
    return rows.groupBy(*by).agg(_status(_any(lost)), F.count("*").alias("n"), F.count_if(lost).cast("double").alias("figure"))


def stress_degradation(degraded: DataFrame, by: list[str]) -> DataFrame:
    """``degraded`` of the curves along the fee: PASS if one of them ends below its start."""
    return degraded.groupBy(*by).agg(_status(_any(F.col("degraded"))), F.count("*").alias("n"), F.count_if("degraded").cast("double").alias("figure"))


def gate_status(wins: DataFrame, by: list[str], won: str, else_status: str) -> DataFrame:
    """``gate_wins``: PASS if the gate wins a comparison, ``else_status`` if it wins none, PARTIAL if nothing can be compared."""
    n = F.count_if("comparable")
    return wins.groupBy(*by).agg(
        _status(_any(F.col("comparable") & F.col(won)), F.when(n > 0, else_status).otherwise("PARTIAL")), n.alias("n"),
        F.count_if(F.col("comparable") & F.col(won)).cast("double").alias("figure"))


def stress_axes(curves: DataFrame, by: list[str], least_axes: int = LEAST_AXES) -> DataFrame:
    n = F.count_distinct("stress_axis")
    return curves.groupBy(*by).agg(_status(n >= least_axes), F.count("*").alias("n"), n.cast("double").alias("figure"))


def interval_support(intervals: DataFrame, by: list[str], least_resamples: int = LEAST_RESAMPLES) -> DataFrame:
    """(n_days, n_resamples, low): PASS if the intervals are sound and all are above zero, PARTIAL if some are not, FAIL if they are not sound.

    Sound: more than one day behind each, and enough resamples behind one of them.
    """
    sound = F.coalesce(F.min(F.col("n_days") > 1), F.lit(False)) & _any(F.col("n_resamples") >= least_resamples)
    above = F.round("low", 9) > 0
    clear = _any(above) & ~_any(~above)
    return intervals.groupBy(*by).agg(
        _status(sound & clear, F.when(sound, "PARTIAL").otherwise("FAIL")), F.count("*").alias("n"), F.count_if(above).cast("double").alias("figure"))


def acceptance_bar(groups: DataFrame, results: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """One row per group of ``groups`` and criterion: (criterion_id, criterion, status, n, figure); what is missing has FAIL."""
    every = groups.select(*by).distinct().select("*", F.explode(F.array(*map(F.lit, CRITERIA))).alias("criterion"))
    found = None
    for name, rows in results.items():
        rows = rows.withColumn("criterion", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    number = F.array_position(F.array(*map(F.lit, CRITERIA)), F.col("criterion"))
    return every.join(found, [*by, "criterion"], "left").select(
        *by, F.format_string("C%02d", number).alias("criterion_id"), "criterion", F.coalesce("status", F.lit("FAIL")).alias("status"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("figure", F.lit(0.0)).alias("figure"))


def claim_status(bar: DataFrame, claims: dict[str, tuple[str, ...]], by: list[str]) -> DataFrame:
    """Each claim with the worst status of the criteria it stands on, and how many of them pass."""
    pairs = [F.struct(F.lit(claim).alias("claim"), F.lit(c).alias("criterion")) for claim, needs in claims.items() for c in needs]
    stands = bar.select(*by, "criterion", "status", F.explode(F.array(*pairs)).alias("_p")).filter("_p.criterion = criterion")
    bad, partial = F.count_if(F.col("status") == "FAIL"), F.count_if(F.col("status") == "PARTIAL")
    return stands.groupBy(*by, F.col("_p.claim").alias("claim")).agg(
        F.when(bad > 0, "NOT_SUPPORTED").when(partial > 0, "PARTIALLY_SUPPORTED").otherwise("SUPPORTED").alias("claim_status"),
        F.count("*").alias("n_criteria"), F.count_if(F.col("status") == "PASS").alias("n_passed"))
