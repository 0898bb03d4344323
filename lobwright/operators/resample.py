"""Daily PnL and day-level bootstrap intervals.

Draw k of resample b is a hash of (seed, b, k), so the intervals are the same on every run, every cluster and every
engine.  The work is resamples x days; it does not grow with the number of trades.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobwright.functions.scalars import hash_below, utc_day


def daily_pnl(trades: DataFrame, by: list[str]) -> DataFrame:
    return trades.groupBy(*by, utc_day(F.col("event_us")).alias("day")).agg(
        F.sum("gross_pnl").alias("gross_pnl"),
        F.sum("net_pnl").alias("net_pnl"),
        F.sum("total_cost").alias("total_cost"),
        F.count("*").alias("n_trades"),
    )


def daily_by_policy(daily: DataFrame, policies: tuple[str, ...], group: list[str]) -> DataFrame:
    """One row per day that any policy traded, a net PnL and a trade count per policy, 0 where it did not trade."""
    cols = []
    for i, p in enumerate(policies):
        mine = F.col("policy") == p
        cols.append(F.coalesce(F.sum(F.when(mine, F.col("net_pnl"))), F.lit(0.0)).alias(f"net_{i}"))
        cols.append(F.coalesce(F.sum(F.when(mine, F.col("n_trades"))), F.lit(0)).alias(f"trades_{i}"))
    days = daily.groupBy(*group, "day").agg(*cols)
    w = Window.partitionBy(*group).orderBy("day")
    return days.withColumn("day_no", F.row_number().over(w) - 1)


def bootstrap_sums(days: DataFrame, n_policies: int, group: list[str], resamples: int = 1000, seed: int = 7) -> DataFrame:
    """Per resample the sums of net PnL and trades of every policy, all on the same drawn days."""
    size = days.groupBy(*group).agg(F.count("*").alias("_n"))
    b = size.select(*group, "_n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    k = b.select(*group, "_n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("k"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("k").cast("string"))
    draws = k.select(*group, "b", hash_below(key, F.col("_n")).alias("day_no"))
    sums = [F.sum(f"{c}_{i}").alias(f"{c}_{i}") for i in range(n_policies) for c in ("net", "trades")]
    return (
        draws.join(days.withColumn("day_no", F.col("day_no").cast("long")), [*group, "day_no"])
        .groupBy(*group, "b")
        .agg(*sums, F.count("*").alias("n_days"))
    )


def _interval(c, low=0.025, high=0.975):
    return F.coalesce(F.percentile(c, F.lit(low)), F.lit(0.0)), F.coalesce(F.percentile(c, F.lit(high)), F.lit(0.0))


def bootstrap_table(
    daily: DataFrame, policies: tuple[str, ...], group: list[str], resamples: int = 1000, seed: int = 7,
    differences: tuple[tuple[int, int], ...] = ((2, 1), (2, 0)),
) -> DataFrame:
    """Policy rows and paired-difference rows: totals, per-trade values, and 95 % percentile intervals."""
    days = daily_by_policy(daily, policies, group)
    sums = bootstrap_sums(days, len(policies), group, resamples, seed)
    items = []
    for i, p in enumerate(policies):
        net, per = F.col(f"net_{i}"), F.try_divide(F.col(f"net_{i}"), F.col(f"trades_{i}"))
        items.append(("policy", p, "", net, per))
    for i, j in differences:
        per_i, per_j = (F.try_divide(F.col(f"net_{x}"), F.col(f"trades_{x}")) for x in (i, j))
        items.append(("difference", policies[i], policies[j], F.col(f"net_{i}") - F.col(f"net_{j}"), per_i - per_j))

    def stack(df, extra):
        arr = F.array(
            *[
                F.struct(
                    F.lit(kind).alias("row_type"),
                    F.lit(a).alias("policy"),
                    F.lit(b).alias("comparison_policy"),
                    net.alias("net"),
                    per.alias("per_trade"),
                )
                for kind, a, b, net, per in items
            ]
        )
        return df.select(*group, *extra, F.explode(arr).alias("_e")).select(*group, *extra, "_e.*")

    key = [*group, "row_type", "policy", "comparison_policy"]
    lo, hi = _interval(F.col("net"))
    plo, phi = _interval(F.col("per_trade"))
    ci = stack(sums, []).groupBy(*key).agg(
        lo.alias("net_ci_low"), hi.alias("net_ci_high"), plo.alias("per_trade_ci_low"), phi.alias("per_trade_ci_high")
    )
    totals = days.groupBy(*group).agg(
        F.count("*").alias("n_days"),
        *[F.sum(f"{c}_{i}").alias(f"{c}_{i}") for i in range(len(policies)) for c in ("net", "trades")],
    )
    point = stack(totals, ["n_days"]).withColumn("net_total", F.col("net")).withColumn(
        "net_per_trade", F.coalesce(F.col("per_trade"), F.lit(0.0))
    )
    return point.drop("net", "per_trade").join(ci, key)


def paired_day_bootstrap(
    daily: DataFrame, a: str, b: str, group: list[str], resamples: int = 1000, seed: int = 7
) -> DataFrame:
    """Mean daily difference a - b over the union of their days, with its interval."""
    days = daily_by_policy(daily.filter(F.col("policy").isin(a, b)), (a, b), group)
    sums = bootstrap_sums(days, 2, group, resamples, seed)
    mean = (F.col("net_0") - F.col("net_1")) / F.col("n_days")
    lo, hi = _interval(mean)
    point = days.groupBy(*group).agg(
        F.avg(F.col("net_0") - F.col("net_1")).alias("mean_diff"), F.count("*").alias("n_days")
    )
    return point.join(sums.groupBy(*group).agg(lo.alias("ci_low"), hi.alias("ci_high")), group)
