"""Dense event index per symbol, without sorting a whole symbol in one task.

Rows are range-partitioned and sorted on the full order (key, time, sequence, position, content) and written with their
place in the partition.  A partition holds a contiguous run of each of its symbols, so the index is the number of the
symbol's rows in earlier partitions plus the place in the run: one small row per (partition, symbol) carries all that has to
be summed up.  The range partitioner balances on the whole order, so neither a long symbol nor a burst in one
microsecond, with equal or missing sequence numbers, fills a task; no row is dropped and no size switches the plan.

The order is total up to equal rows, and the sorted rows are stored, so another layout, a retry or a lost executor gives
the same index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobwright.functions.scalars import KEYS
from lobwright.sources.stages import cut, per_key

#: Columns that say where a row stood in its source, in the order in which they break ties.
POSITION = ("source_file", "row_index", "arrival")


def event_index(
    df: DataFrame,
    keys: tuple[str, ...] = KEYS,
    time_col: str = "event_us",
    seq_col: str = "sequence_number",
    tiebreak: tuple[str, ...] | None = None,
    missing_time: bool = False,
) -> DataFrame:
    """Adds ``event_idx``: 0, 1, 2, ... per key in (time, sequence, tiebreak, content) order.

    ``tiebreak`` defaults to those of ``POSITION`` that the table has.  Missing sequences come first within their time.
    Keys must not be NULL; nor must times, unless ``missing_time`` lets rows without one come first in their key.
    """
    keys = list(keys)
    ties = [c for c in POSITION if c in df.columns] if tiebreak is None else list(tiebreak)
    order = [*keys, time_col, seq_col, *[c for c in ties if c not in (time_col, seq_col)], "_content"]
    placed = df.withColumn("_content", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).repartitionByRange(*order).sortWithinPartitions(*order)
    stored = cut(placed.drop("_content").withColumn("_at", F.monotonically_increasing_id()), "indexed")
    part = F.shiftrightunsigned("_at", 33)
    runs = per_key(stored.groupBy(*keys, part.alias("_part")).agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first"), F.count_if(F.col(time_col).isNull()).alias("_untimed")))
    bad = F.greatest(*[F.col(c).isNull() for c in keys], F.lit(False) if missing_time else F.col("_untimed") > 0)
    if runs.filter(bad).limit(1).count():
        raise ValueError(f"event_index: {keys} and {time_col} must not be NULL")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_key(runs.select(*keys, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return (
        stored.withColumn("_part", part)
        .join(starts, [*keys, "_part"])
        .withColumn("event_idx", (F.col("_start") + F.col("_at") - F.col("_first")).cast("long"))
        .drop("_part", "_at", "_first", "_start")
    )


def event_stride(df: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th event of each symbol, starting with the first."""
    return df if stride <= 1 else df.filter(F.col("event_idx") % stride == 0)
