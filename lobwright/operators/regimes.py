"""Quantile-fitted market regimes and their diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobwright.functions.scalars import KEYS, utc_day, utc_month, zero_if_null
from lobwright.operators.chunks import CHUNK_ROWS, chunk_window, drop_halo, with_halo
from lobwright.operators.quantiles import EXACT_ROWS, group_quantiles
from lobwright.sources.stages import per_key

# Quantile settings, regime order and threshold quantiles.
SETTINGS = {
    "baseline": {"low": 0.40, "mid": 0.50, "high": 0.70, "very_high": 0.80, "very_low": 0.10},
    "strict_extremes": {"low": 0.45, "mid": 0.50, "high": 0.75, "very_high": 0.85, "very_low": 0.05},
    "relaxed_extremes": {"low": 0.35, "mid": 0.50, "high": 0.65, "very_high": 0.75, "very_low": 0.15},
}
THRESHOLDS = {
    "vol_q40": ("vol_score", "low"),
    "vol_q70": ("vol_score", "high"),
    "spread_q40": ("rel_spread", "low"),
    "spread_q70": ("rel_spread", "high"),
    "depth_q40": ("total_depth_10", "low"),
    "depth_q60": ("total_depth_10", 0.60),
    "depth_drop_q10": ("depth_drop_top10", "very_low"),
    "spread_z_q80": ("spread_z_1m", "very_high"),
    "momentum_abs_q80": ("momentum_abs", "very_high"),
    "adverse_q70": ("adverse_selection_score", "high"),
    "flip_q70": ("choppiness_score", "high"),
    "momentum_abs_q50": ("momentum_abs", "mid"),
    "stress_q35": ("stress_score", 0.35),
    "stress_q60": ("stress_score", 0.60),
    "stress_q80": ("stress_score", 0.80),
    "liquidity_q30": ("liquidity_score", 0.30),
    "liquidity_q45": ("liquidity_score", 0.45),
    "liquidity_q70": ("liquidity_score", 0.70),
    "toxicity_q45": ("directional_toxicity_score", 0.45),
    "toxicity_q65": ("directional_toxicity_score", 0.65),
    "choppy_q60": ("choppiness_score", 0.60),
    "drought_q55": ("liquidity_drought_score", 0.55),
    "drought_q70": ("liquidity_drought_score", 0.70),
}
# The rule table.  Each rule: tests joined by "and", as (score, comparison, threshold).  First rule that holds wins.
RULES = {
    "LIQUIDITY_DROUGHT": [("depth_drop_top10", "<=", "depth_drop_q10"), ("spread_z_1m", ">=", "spread_z_q80")],
    "MOMENTUM_TOXIC": [("momentum_abs", ">=", "momentum_abs_q80"), ("adverse_selection_score", ">=", "adverse_q70")],
    "VOLATILE_ILLIQUID": [
        ("vol_score", ">=", "vol_q70"), ("rel_spread", ">=", "spread_q70"), ("total_depth_10", "<=", "depth_q40"),
    ],
    "CHOPPY_MEAN_REVERTING": [("choppiness_score", ">=", "flip_q70"), ("momentum_abs", "<=", "momentum_abs_q50")],
    "SHOCK_RECOVERY": [
        ("vol_score", ">=", "vol_q70"), ("depth_drop_top10", ">", "depth_drop_q10"), ("spread_z_1m", "<", "spread_z_q80"),
    ],
    "VOLATILE_LIQUID": [
        ("vol_score", ">=", "vol_q70"), ("rel_spread", "<=", "spread_q40"), ("total_depth_10", ">=", "depth_q60"),
    ],
    "CALM_ILLIQUID": [
        ("vol_score", "<=", "vol_q40"), ("rel_spread", ">=", "spread_q70"), ("total_depth_10", "<=", "depth_q40"),
    ],
    "CALM_LIQUID": [
        ("vol_score", "<=", "vol_q40"), ("rel_spread", "<=", "spread_q40"), ("total_depth_10", ">=", "depth_q60"),
    ],
    "MILD_LIQUIDITY_STRESS": [
        ("stress_score", ">=", "stress_q35"), ("stress_score", "<=", "stress_q80"),
        [("liquidity_score", "<=", "liquidity_q45"), ("liquidity_drought_score", ">=", "drought_q55")],
    ],
    "BALANCED_TRANSITION": [
        ("stress_score", "<=", "stress_q60"), ("directional_toxicity_score", "<=", "toxicity_q65"),
        ("liquidity_score", ">=", "liquidity_q30"),
    ],
}
UNKNOWN = "UNKNOWN"
# Scores and thresholds meet after rounding, so that interpolation noise in the last bits cannot turn a rule.
DIGITS = 9


def taxonomy_scores(df: DataFrame) -> DataFrame:
    """Liquidity, stress and directional-toxicity scores."""
    spread_z, depth_z = zero_if_null(F.col("spread_z_1m")), zero_if_null(F.col("depth_z_1m"))
    mom = F.abs(F.col("momentum_score"))
    return df.withColumns(
        {
            "liquidity_score": depth_z - spread_z,
            "stress_score": zero_if_null(F.col("vol_score")) + spread_z - depth_z,
            "directional_toxicity_score": zero_if_null(mom) + zero_if_null(F.col("adverse_selection_score")),
            "momentum_abs": mom,
        }
    )


def sequence_length(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return per_key(df.groupBy(*keys).agg(F.count("*").alias("n_events")))


def train_prefix(df: DataFrame, fraction: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The first ``fraction`` of each symbol's rows, at least one; ``event_idx`` must be dense."""
    n = sequence_length(df, keys)
    cut = F.greatest(F.lit(1), F.floor(F.col("n_events") * F.lit(fraction)))
    return df.join(n, list(keys)).filter(F.col("event_idx") < cut).drop("n_events")


def fit_thresholds(
    df: DataFrame,
    train_fraction: float = 0.6,
    quantiles: dict[str, float] | None = None,
    keys: tuple[str, ...] = KEYS,
    exact_rows: int = EXACT_ROWS,
    prefix: str = "",
) -> DataFrame:
    """One row of cut points per symbol, fitted on its train prefix only."""
    return fit_settings(df, {prefix: quantiles or SETTINGS["baseline"]}, train_fraction, keys, exact_rows)


def fit_settings(
    df: DataFrame, settings: dict[str, dict[str, float]], train_fraction: float = 0.6, keys: tuple[str, ...] = KEYS,
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """One row per symbol with the cut points of every setting, each under its prefix: one pass over the train prefix."""
    train = train_prefix(taxonomy_scores(df), train_fraction, keys)
    wanted = {
        prefix + name: (F.col(score), q[level] if isinstance(level, str) else level)
        for prefix, q in settings.items()
        for name, (score, level) in THRESHOLDS.items()
    }
    return per_key(group_quantiles(train, list(keys), wanted, exact_rows))


def _test(score: str, how: str, threshold: str, prefix: str) -> Column:
    a, b = F.round(F.col(score), DIGITS), F.round(F.col(prefix + threshold), DIGITS)
    return {"<=": a <= b, ">=": a >= b, "<": a < b, ">": a > b}[how]


def rule_cascade(prefix: str = "") -> Column:
    """The regime of a row that carries its scores and thresholds."""

    def holds(rule) -> Column:
        tests = [
            reduce(lambda x, y: x | y, [_test(*alt, prefix) for alt in t]) if isinstance(t, list) else _test(*t, prefix)
            for t in rule
        ]
        return reduce(lambda x, y: x & y, tests)

    names = list(RULES)
    expr = F.when(holds(RULES[names[0]]), names[0])
    for name in names[1:]:
        expr = expr.when(holds(RULES[name]), name)
    return expr.otherwise(UNKNOWN)


def apply_regimes(df: DataFrame, thresholds: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds the taxonomy scores and ``regime``.  The threshold table has one row per symbol."""
    joined = taxonomy_scores(df).join(thresholds, list(keys))
    return joined.withColumn("regime", rule_cascade()).drop(*THRESHOLDS, "momentum_abs")


def sensitivity(df: DataFrame, train_fraction: float = 0.6, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Regime shares under three quantile settings and agreement with the first, over all rows: one fit and one scan."""
    cuts = fit_settings(df, {f"{s}__": q for s, q in SETTINGS.items()}, train_fraction, keys)
    joined = taxonomy_scores(df).join(cuts, list(keys))
    labelled = joined.select("symbol", *[rule_cascade(f"{s}__").alias(s) for s in SETTINGS])
    combos = labelled.groupBy("symbol", *SETTINGS).agg(F.count("*").alias("n"))
    stacked = combos.select(
        "symbol",
        "n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("setting"),
                        F.col(s).alias("regime"),
                        (F.col(s) == F.col("baseline")).cast("long").alias("same"),
                    )
                    for s in SETTINGS
                ]
            )
        ).alias("e"),
    ).select("symbol", "n", "e.*")
    total = stacked.groupBy("symbol", "setting").agg(
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("same")).alias("agree"),
        F.sum(F.when(F.col("regime") == UNKNOWN, F.col("n")).otherwise(0)).alias("unknown"),
    )
    return (
        stacked.groupBy("symbol", "setting", "regime")
        .agg(F.sum("n").alias("n_rows"))
        .join(total, ["symbol", "setting"])
        .select(
            "symbol",
            "setting",
            "regime",
            "n_rows",
            (F.col("n_rows") / F.col("total")).alias("share"),
            (F.col("unknown") / F.col("total")).alias("unknown_share"),
            (F.col("agree") / F.col("total")).alias("agreement_with_baseline"),
        )
    )


def seven_regimes(df: DataFrame, train_split: str = "train", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The seven-regime variant: later rules override earlier ones, thresholds from the train split."""
    train = df.filter(F.col("split") == train_split)
    q = per_key(group_quantiles(
        train,
        list(keys),
        {
            "_spread_hi": (F.col("rel_spread"), 0.70),
            "_depth_lo": (F.col("total_depth_10"), 0.30),
            "_depth_hi": (F.col("total_depth_10"), 0.70),
            "_vol_hi": (F.col("realized_vol_20"), 0.70),
            "_vol_lo": (F.col("realized_vol_20"), 0.40),
            "_mom_hi": (F.abs(F.col("momentum_score")), 0.80),
        },
    ))
    d = df.join(q, list(keys))

    def at(score: Column, how: str, cut: str) -> Column:
        a, b = F.round(score, DIGITS), F.round(F.col(cut), DIGITS)
        return a >= b if how == ">=" else a <= b

    vol, dep = F.col("realized_vol_20"), F.col("total_depth_10")
    drought = at(F.col("rel_spread"), ">=", "_spread_hi") & at(dep, "<=", "_depth_lo")
    volatile, liquid, calm = at(vol, ">=", "_vol_hi"), at(dep, ">=", "_depth_hi"), at(vol, "<=", "_vol_lo")
    moving = at(F.abs(F.col("momentum_score")), ">=", "_mom_hi")
    regime = (
        F.when(~(drought | volatile | calm | moving | liquid), UNKNOWN)
        .when(moving & ~drought, "MOMENTUM_TOXIC")
        .when(calm & liquid, "CALM_LIQUID")
        .when(volatile & ~liquid, "VOLATILE_ILLIQUID")
        .when(volatile & liquid, "VOLATILE_LIQUID")
        .when(drought, "LIQUIDITY_DROUGHT")
        .otherwise("BALANCED_TRANSITION")
    )
    return d.withColumn("regime", regime).drop(*[c for c in q.columns if c not in keys])


# ---------------------------------------------------------------- diagnostics

def share_within(df: DataFrame, group: list[str], n: str = "n_rows", total: str = "split_total_rows",
                 share: str = "share_within_split") -> DataFrame:
    """Adds the group's total and each row's share of it; ``df`` is an aggregate, not raw rows."""
    w = Window.partitionBy(*group)
    return df.withColumn(total, F.sum(n).over(w)).withColumn(share, F.col(n) / F.greatest(F.col(total), F.lit(1)))


def regime_counts_by_month(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", utc_month(F.col("event_us")).alias("month"), "regime").agg(F.count("*").alias("n_rows"))


def regime_share(df: DataFrame) -> DataFrame:
    counts = df.groupBy("symbol", "regime").agg(F.count("*").alias("n_rows"))
    return share_within(counts, ["symbol"], total="total_rows", share="share")


def unknown_share(df: DataFrame, by: str = "day") -> DataFrame:
    period = utc_day(F.col("event_us")) if by == "day" else utc_month(F.col("event_us"))
    return df.groupBy("symbol", period.alias("period")).agg(
        F.avg((F.col("regime") == UNKNOWN).cast("double")).alias("unknown_share")
    )


MEDIAN_COLUMNS = (
    "rel_spread", "total_depth_10", "vol_score", "liquidity_drought_score", "adverse_selection_score",
    "liquidity_score", "stress_score", "directional_toxicity_score",
)


def regime_medians(df: DataFrame, columns: tuple[str, ...] = MEDIAN_COLUMNS) -> DataFrame:
    return group_quantiles(df, ["symbol", "regime"], {c: (F.col(c), 0.5) for c in columns if c in df.columns})


def counts_by_split(df: DataFrame) -> DataFrame:
    counts = df.groupBy("symbol", "split", "regime").agg(F.count("*").alias("n_rows"))
    return share_within(counts, ["symbol", "split"])


def month_share_pivot(df: DataFrame) -> DataFrame:
    """Share of each regime by symbol and month, one column per regime."""
    counts = share_within(regime_counts_by_month(df), ["symbol", "month"], share="share")
    names = [*RULES, UNKNOWN]
    pivot = counts.groupBy("symbol", "month").pivot("regime", names).agg(F.sum("share"))
    return pivot.na.fill(0.0, names)


def dominant_regime_by_day(df: DataFrame) -> DataFrame:
    """The most frequent regime of each day; a tie goes to the first in alphabetical order."""
    counts = df.groupBy("symbol", utc_day(F.col("event_us")).alias("date"), "regime").agg(F.count("*").alias("n_rows"))
    w = Window.partitionBy("symbol", "date").orderBy(F.desc("n_rows"), "regime")
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def audit_regimes(df: DataFrame, limit: float = 0.15) -> DataFrame:
    """Rows, share of UNKNOWN, 90th percentile of the daily share, and a verdict per symbol."""
    day = df.groupBy("symbol", utc_day(F.col("event_us")).alias("date")).agg(
        F.count("*").alias("n"), F.count_if(F.col("regime") == UNKNOWN).alias("u")
    )
    out = day.groupBy("symbol").agg(
        F.sum("n").alias("n_rows"),
        F.sum("u").alias("unknown_rows"),
        F.percentile(F.col("u") / F.col("n"), F.lit(0.9)).alias("daily_unknown_p90"),
        F.count("*").alias("n_days"),
    )
    share = F.col("unknown_rows") / F.col("n_rows")
    return out.withColumn("unknown_share", share).withColumn(
        "status", F.when(F.col("unknown_share") < limit, "PASS").otherwise("REVIEW")
    )


def run_lengths(df: DataFrame, value: str = "regime", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per maximal run of equal ``value``, per symbol in event order.

    Runs are found inside each chunk; only the first and last run of a chunk can touch a neighbour, and those few
    are joined up in a second step over chunk ends.
    """
    w = chunk_window()
    slim = df.select(*KEYS, "event_idx", F.col(value).alias("_value"))
    flagged = with_halo(slim, back=1, chunk_rows=chunk_rows).withColumn("_prev", F.lag("_value").over(w))
    flagged = flagged.filter(F.col("_chunk") == F.col("_home")).withColumn(
        "_new", F.when(F.col("_prev").eqNullSafe(F.col("_value")), 0).otherwise(1)
    )
    inside = w.rowsBetween(Window.unboundedPreceding, 0)
    # Run 0 continues the previous chunk's last run; a run that starts here is numbered from 1.
    segs = (
        flagged.withColumn("_run", F.sum("_new").over(inside))
        .groupBy(*KEYS, "_chunk", "_run", "_value")
        .agg(F.count("*").alias("n"), F.min("event_idx").alias("first_idx"))
    )
    last = segs.groupBy(*KEYS, "_chunk").agg(F.max("_run").alias("_last"))
    segs = segs.join(last, [*KEYS, "_chunk"])
    edge = (F.col("_run") == 0) | (F.col("_run") == F.col("_last"))
    by_key = Window.partitionBy(*KEYS).orderBy("_chunk", "_run").rowsBetween(Window.unboundedPreceding, 0)
    joined = (
        segs.filter(edge)
        .withColumn("_g", F.sum(F.when(F.col("_run") == 0, 0).otherwise(1)).over(by_key))
        .groupBy(*KEYS, "_g", "_value")
        .agg(F.sum("n").alias("n"), F.min("first_idx").alias("first_idx"))
        .drop("_g")
    )
    cols = [*KEYS, F.col("_value").alias(value), "first_idx", F.col("n").alias("run_length")]
    return segs.filter(~edge).select(*cols).unionByName(joined.select(*cols))


def run_length_summary(df: DataFrame, value: str = "regime", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Count, mean, quantiles and maximum of run lengths per symbol and value."""
    lengths = run_lengths(df, value, chunk_rows).groupBy("symbol", value, "run_length").agg(F.count("*").alias("k"))
    return lengths.groupBy("symbol", value).agg(
        F.sum("k").alias("n_runs"),
        (F.sum(F.col("run_length") * F.col("k")) / F.sum("k")).alias("mean_run_length"),
        *[F.percentile("run_length", F.lit(p / 100), F.col("k")).alias(f"p{p}_run_length") for p in (50, 90, 99)],
        F.max("run_length").alias("max_run_length"),
    )


def taxonomy_table() -> list[tuple[str, str]]:
    """Regime and the text of its rule, in priority order."""

    def text(t) -> str:
        return "(" + " or ".join(" ".join(a) for a in t) + ")" if isinstance(t, list) else " ".join(t)

    return [(name, " and ".join(text(t) for t in rule)) for name, rule in RULES.items()] + [(UNKNOWN, "no rule holds")]
