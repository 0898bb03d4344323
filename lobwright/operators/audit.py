"""Daily data-quality audit, dataset statistics and distribution histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobwright.functions.levels import any_level, depth, price
from lobwright.functions.scalars import KEYS, utc_day
from lobwright.operators.chunks import CHUNK_ROWS, chunk_window, drop_halo, with_halo
from lobwright.operators.clean import with_event_time
from lobwright.operators.index import event_index
from lobwright.operators.quantiles import group_quantiles
from lobwright.sources.stages import cut, per_key

AUDITED_LEVELS = 10

#: Fixed value: the day of rows that have no time.
NO_DAY = "NaT"


def _null_count_columns() -> dict[str, str]:
    plain = {c: c for c in ("origin_time", "received_time", "event_time", "sequence_number")}
    levels = {}
    for side in ("bid", "ask"):
        for field in ("price", "size"):
            for i in range(20):
                levels[f"{side}_{i}_{field}"] = f"{side}s[{i}].{field}"
    return {**plain, **levels}


def audit_rows(df: DataFrame, chunk_rows: int = CHUNK_ROWS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per-row audit inputs.  ``event_idx`` must follow (event time, sequence) per ``keys``; gaps do not cross a day.

    Rows without a time belong to the day ``NO_DAY``.
    """
    w = chunk_window(keys)
    day = F.coalesce(utc_day(F.col("event_us")), F.lit(NO_DAY))
    flags = df.withColumns(
        {
            "trade_date": day,
            "_spread": price("ask", 0) - price("bid", 0),
            "_depth": depth("bid", AUDITED_LEVELS) + depth("ask", AUDITED_LEVELS),
            "_crossed": F.coalesce(price("bid", 0) > price("ask", 0), F.lit(False)),
            "_bad_price": any_level("bid", "l.price <= 0") | any_level("ask", "l.price <= 0"),
            "_bad_size": any_level("bid", "l.size <= 0") | any_level("ask", "l.size <= 0"),
            "_nulls": F.expr("array(" + ", ".join(f"int({c} is null)" for c in _null_count_columns().values()) + ")"),
        }
    ).drop("bids", "asks")
    out = with_halo(flags, back=1, chunk_rows=chunk_rows).withColumns(
        {f"_before_{c}": F.lag(c).over(w) for c in ("event_us", "sequence_number", "trade_date")}
    )
    same_day = F.col("_before_trade_date") == F.col("trade_date")
    return drop_halo(
        out.withColumns(
            {
                "_interval_ms": F.when(same_day, (F.col("event_us") - F.col("_before_event_us")) / F.lit(1000.0)),
                "_seq_back": F.coalesce(same_day & (F.col("sequence_number") < F.col("_before_sequence_number")), F.lit(False)),
            }
        )
    )


def audit_daily(df: DataFrame, chunk_rows: int = CHUNK_ROWS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per ``keys``, those of the index, and UTC day."""
    # Counts, distinct counts and quantiles all read these narrow rows, so they are written once.
    rows = cut(audit_rows(df, chunk_rows, keys), "audit_rows")
    group = [*keys, "trade_date"]
    names = list(_null_count_columns())
    # Duplicates: distinct values are counted in two steps, so a day's values never meet in one task's set.
    uniq = None
    for col, out in (("event_us", "_distinct_us"), ("sequence_number", "_distinct_seq")):
        d = rows.groupBy(*group, col).agg(F.lit(1).alias("_one")).groupBy(*group).agg(F.count("*").alias(out))
        uniq = d if uniq is None else uniq.join(d, group)
    main = rows.groupBy(*group).agg(
        F.count("*").alias("n_rows"),
        F.min("event_us").alias("first_us"),
        F.max("event_us").alias("last_us"),
        F.avg("_interval_ms").alias("mean_snapshot_interval_ms"),
        F.count_if("_seq_back").alias("n_non_monotonic_sequence"),
        F.count_if("_crossed").alias("n_crossed_book_rows"),
        F.count_if("_bad_price").alias("n_zero_or_negative_price_rows"),
        F.count_if("_bad_size").alias("n_zero_or_negative_size_rows"),
        F.avg("_spread").alias("spread_mean"),
        F.avg("_depth").alias("depth_top10_mean"),
        *[F.expr(f"sum(_nulls[{i}]) as _null_{n}") for i, n in enumerate(names)],
    )
    pairs = ", ".join(f"struct('{n}' as key, _null_{n} as value)" for n in sorted(names))
    missing = F.expr(f"to_json(map_from_entries(filter(array({pairs}), p -> p.value > 0)))")
    quant = group_quantiles(
        rows,
        group,
        {
            "p50_snapshot_interval_ms": (F.col("_interval_ms"), 0.5),
            "p95_snapshot_interval_ms": (F.col("_interval_ms"), 0.95),
            "p99_snapshot_interval_ms": (F.col("_interval_ms"), 0.99),
            "spread_p50": (F.col("_spread"), 0.5),
            "spread_p95": (F.col("_spread"), 0.95),
            "depth_top10_p50": (F.col("_depth"), 0.5),
            "depth_top10_p95": (F.col("_depth"), 0.95),
        },
    )
    zero = [f"p{p}_snapshot_interval_ms" for p in (50, 95, 99)] + ["mean_snapshot_interval_ms"]
    return (
        main.withColumn("n_missing_values_by_column", missing)
        .drop(*[f"_null_{n}" for n in names])
        .join(uniq, group)
        .join(quant, group)
        .withColumns(
            {
                "duration_seconds": (F.col("last_us") - F.col("first_us")) / F.lit(1e6),
                "n_duplicate_timestamps": F.col("n_rows") - F.col("_distinct_us"),
                "n_duplicate_sequence_numbers": F.col("n_rows") - F.col("_distinct_seq"),
                **{c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero},
            }
        )
        .drop("_distinct_us", "_distinct_seq")
    )


def audit_files(files: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per source file, symbol and UTC day, with the file's size; ``files`` comes from ``read_with_origin``.

    Intervals, duplicates and sequence steps are those within a file.  Equal times and sequences follow the order of the file.
    """
    keys = (*KEYS, "source_file")
    indexed = event_index(with_event_time(files), keys, missing_time=True)
    sizes = per_key(files.groupBy("source_file").agg(F.max("source_file_size_mb").alias("file_size_mb")))
    return audit_daily(indexed, chunk_rows, keys).join(sizes, "source_file")


def first_priority(audits: DataFrame) -> DataFrame:
    """Of the audits of a (symbol, day) keep those from the best source; needs ``source_priority``."""
    best = audits.groupBy("symbol", "trade_date").agg(F.min("source_priority").alias("source_priority"))
    return audits.join(best, ["symbol", "trade_date", "source_priority"])


def dataset_stats(audits: DataFrame) -> DataFrame:
    """Rows, days, median of daily medians and unweighted mean of daily means, per symbol."""
    return first_priority(audits).groupBy("exchange", "symbol").agg(
        F.sum("n_rows").alias("rows"),
        F.count_distinct("trade_date").alias("days"),
        F.percentile("p50_snapshot_interval_ms", F.lit(0.5)).alias("median_snapshot_interval_ms"),
        F.avg("spread_mean").alias("mean_spread"),
        F.avg("depth_top10_mean").alias("mean_depth_top10"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.concat_ws(";", F.sort_array(F.collect_set("source"))).alias("source_audit_artifact"),
    )


def histogram(df: DataFrame, value: Column, bins: int = 50, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Equal-width bins between the group's minimum and maximum, over all rows."""
    keys = list(keys)
    vals = df.select(*keys, value.alias("_v")).filter(F.col("_v").isNotNull())
    span = per_key(vals.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.coalesce(F.try_divide(F.col("_v") - F.col("lo"), width), F.lit(0.0))
    bin_no = F.least(F.floor(F.round(place, 9)), F.lit(bins - 1))
    return (
        vals.join(span, keys)
        .groupBy(*keys, bin_no.cast("long").alias("bin"), "lo", "hi")
        .agg(F.count("*").alias("n"))
    )


