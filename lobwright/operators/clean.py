"""Schema checks, cleaning and strict validation of snapshot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobwright.functions.levels import BOOK_LEVELS, Levels, any_level, price
from lobwright.functions.scalars import KEYS, event_time, micros
from lobwright.operators.chunks import CHUNK_ROWS, chunk_window, drop_halo, with_halo
from lobwright.sources.book import book_columns


class SchemaMismatch(ValueError):
    """Required columns are missing."""


def check_schema(columns, levels: int = BOOK_LEVELS) -> dict[str, object]:
    have, want = set(columns), set(book_columns(levels))
    return {"ok": want <= have, "missing": sorted(want - have), "extra": sorted(have - want)}


def require_columns(df: DataFrame, needed, what: str = "table") -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise SchemaMismatch(f"{what} lacks columns {missing}")
    return df


def with_event_time(df: DataFrame) -> DataFrame:
    ts = event_time(F.col("origin_time").cast("string"), F.col("received_time").cast("string"))
    return df.withColumn("event_time", ts).withColumn("event_us", micros(F.col("event_time")))


def usable_top(columns, drop_crossed: bool = True) -> Column:
    lv = Levels(columns)
    b, a, bs, az = lv.px("bid", 0), lv.px("ask", 0), lv.sz("bid", 0), lv.sz("ask", 0)
    ok = f"{b} > 0 and {a} > 0 and {bs} > 0 and {az} > 0"
    return F.expr(f"{ok} and {b} <= {a}" if drop_crossed else ok)


def clean_book(df: DataFrame, drop_crossed: bool = True) -> DataFrame:
    """Rows with an event time and a usable best quote.  Locked books stay; a missing sequence becomes -1."""
    return (
        with_event_time(df)
        .filter(F.col("event_time").isNotNull() & usable_top(df.columns, drop_crossed))
        .withColumn("sequence_number", F.coalesce(F.col("sequence_number").try_cast("long"), F.lit(-1).cast("long")))
    )


def keep_last_duplicate(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Optional: of rows with the same key and event time keep the highest sequence number."""
    latest = df.groupBy(*keys, "event_us").agg(F.max("sequence_number").alias("sequence_number"))
    return df.join(latest, [*keys, "event_us", "sequence_number"])


def _ordered(side: str) -> Column:
    worse = ">=" if side == "bid" else "<="
    n = f"size({side}s) - 1"
    pairs = f"zip_with(slice({side}s, 1, {n}), slice({side}s, 2, {n}), (x, y) -> x.price {worse} y.price)"
    return F.expr(f"forall({pairs}, ok -> coalesce(ok, false))")


def strict_checks(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per symbol with the number of rows that break each strict rule.

    Needs ``event_us`` and ``event_idx`` in arrival order; time must not go back, the best quotes must not touch,
    sizes must not be negative and prices must be sorted away from the mid.
    """
    w = chunk_window()
    stepped = drop_halo(
        with_halo(df, back=1, chunk_rows=chunk_rows).withColumn("_before", F.lag("event_us").over(w))
    )
    negative = any_level("bid", "l.size < 0") | any_level("ask", "l.size < 0")
    uncrossed = F.coalesce(price("bid", 0) < price("ask", 0), F.lit(False))
    per_time = stepped.groupBy(*KEYS, "event_us").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("event_us") < F.col("_before")).alias("back"),
        F.count_if(~uncrossed).alias("touching"),
        F.count_if(negative).alias("negative"),
        F.count_if(~_ordered("bid")).alias("bid_bad"),
        F.count_if(~_ordered("ask")).alias("ask_bad"),
    )
    return (
        per_time.groupBy(*KEYS)
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(F.col("event_us").isNull(), F.col("n")).otherwise(0)).alias("n_bad_time"),
            F.sum("back").alias("n_time_backwards"),
            F.sum("touching").alias("n_touching_best"),
            F.sum("negative").alias("n_negative_size"),
            F.sum("bid_bad").alias("n_bid_unsorted"),
            F.sum("ask_bad").alias("n_ask_unsorted"),
            F.sum(F.when(F.col("event_us").isNotNull(), F.col("n") - 1).otherwise(0)).alias("n_duplicate_times"),
        )
        .withColumn(
            "ok",
            (F.col("n_bad_time") + F.col("n_time_backwards") + F.col("n_touching_best") + F.col("n_negative_size")
             + F.col("n_bid_unsorted") + F.col("n_ask_unsorted")) == 0,
        )
    )


def validate_book(df: DataFrame, mode: str = "report") -> DataFrame:
    """``strict_checks``, or an error naming the failing symbols when ``mode='error'``."""
    report = strict_checks(df)
    if mode == "error":
        bad = [r["symbol"] for r in report.filter(~F.col("ok")).select("symbol").take(20)]
        if bad:
            raise ValueError(f"snapshot table fails strict validation for {bad}")
    return report
