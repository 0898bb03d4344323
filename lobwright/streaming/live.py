"""Live features, labels and decisions on a snapshot stream.

Every micro-batch is joined to the tail of what came before (the rows features look back at, per symbol) and goes through
the same chunked batch operators, so there is one definition of every feature and a busy symbol still spreads over many
tasks.  The tail of batch n is a table of its own, written beside the output of batch n: a batch that is run again after
a failure reads the same tail and overwrites the same output.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobwright.functions.scalars import KEYS
from lobwright.operators.clean import clean_book
from lobwright.operators.features import (
    LOOK_BACK,
    depth_features,
    distance_features,
    price_features,
    sequence_features,
)
from lobwright.operators.index import event_index
from lobwright.sources.stages import cut, per_key, scratch

TAIL_COLUMNS = (*KEYS, "event_us", "sequence_number", "event_idx", "bids", "asks")


LIVE_COLUMNS = (
    *KEYS, "event_us", "event_idx", "sequence_number", "mid_price", "spread", "rel_spread", "microprice_deviation",
    "depth_imbalance_1", "depth_imbalance_5", "depth_imbalance_10", "total_depth_10", "ofi_1", "ofi_5", "realized_vol_20",
    "realized_vol_100", "return_autocorr_100", "spread_z_1m", "depth_z_1m", "liquidity_drought_score",
    "adverse_selection_score", "momentum_score", "choppiness_score", "latency_sensitivity_score", "depth_drop_top10", "vol_score",
)


def live_features(rows: DataFrame, columns: tuple[str, ...] = LIVE_COLUMNS) -> DataFrame:
    return sequence_features(distance_features(depth_features(price_features(rows))), columns=columns)


class LiveBook:
    """``foreachBatch`` function: cleans, indexes and transforms each batch.

    ``transform`` maps indexed snapshots (tail and new rows) to output rows with keys and ``event_idx``.  ``delay`` is the
    number of rows a result waits for: 0 emits each row at once, h emits a row when its h-th successor has arrived.
    Rows at or before the last accepted (time, sequence) of their symbol cannot be placed any more and go to the late
    table; a higher sequence at the same time is placed.  A batch's working folders are removed when its output is written.
    """

    def __init__(self, root: str, transform: Callable[[DataFrame], DataFrame] = live_features, delay: int = 0,
                 look_back: int = LOOK_BACK):
        self.root, self.transform, self.delay, self.look_back = root, transform, delay, look_back

    def _path(self, kind: str, batch_id: int) -> str:
        return os.path.join(self.root, kind, f"batch={batch_id}")

    def _tail(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        return spark.read.parquet(self._path("tail", batch_id - 1)) if batch_id > 0 else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            self._run(batch, batch_id)

    def _run(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = clean_book(batch).select(*[c for c in TAIL_COLUMNS if c != "event_idx"])
        tail = self._tail(spark, batch_id)
        if tail is None:
            rows = event_index(new).withColumn("_seen", F.lit(-1).cast("long"))
        else:
            place = F.struct("event_us", "sequence_number")
            last = per_key(tail.groupBy(*KEYS).agg(F.max(place).alias("_last"), F.max("event_idx").alias("_seen")))
            placed = new.join(last, list(KEYS), "left").na.fill(-1, ["_seen"])
            late = F.coalesce(place <= F.col("_last"), F.lit(False))
            placed = cut(placed.withColumn("_late", late).drop("_last"), "live_new")
            placed.filter("_late").drop("_late", "_seen").write.mode("overwrite").parquet(self._path("late", batch_id))
            fresh = event_index(placed.filter("not _late").drop("_late"))
            shifted = fresh.withColumn("event_idx", F.col("event_idx") + F.col("_seen") + 1)
            rows = tail.join(last.select(*KEYS, "_seen"), list(KEYS)).unionByName(shifted)
        # Written once, read by the tail and by the transform.
        rows = cut(rows.select(*TAIL_COLUMNS, "_seen"), "live_rows")
        self._write_tail(rows, batch_id)
        seen = per_key(rows.groupBy(*KEYS).agg(F.max("_seen").alias("_seen")))
        out = self.transform(rows.select(*TAIL_COLUMNS)).join(seen, list(KEYS))
        # With a delay, rows up to _seen - delay were emitted before.
        out = out.filter(F.col("event_idx") > F.col("_seen") - self.delay).drop("_seen")
        out.write.mode("overwrite").parquet(self._path("out", batch_id))

    def _write_tail(self, rows: DataFrame, batch_id: int) -> None:
        keep = self.look_back + self.delay
        top = per_key(rows.groupBy(*KEYS).agg(F.max("event_idx").alias("_top")))
        tail = rows.join(top, list(KEYS)).filter(F.col("event_idx") > F.col("_top") - keep)
        tail.select(*TAIL_COLUMNS).write.mode("overwrite").parquet(self._path("tail", batch_id))

    def results(self, spark: SparkSession, kind: str = "out") -> DataFrame:
        return spark.read.parquet(os.path.join(self.root, kind)).drop("batch")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes everything that has arrived and returns; the next call continues after it."""
    query = (
        stream.writeStream.foreachBatch(sink)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def minute_audit(stream: DataFrame, lateness: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Rows, crossed books and mean spread per symbol and tumbling event-time window.

    Works on a stream and on a table; old windows leave the state when the watermark passes them.
    """
    timed = stream.withWatermark("event_time", lateness) if stream.isStreaming else stream
    spread = F.expr("asks[0].price - bids[0].price")
    return timed.groupBy(F.window("event_time", window).alias("w"), "symbol").agg(
        F.count("*").alias("n_rows"),
        F.count_if(spread < 0).alias("n_crossed"),
        F.count_if(F.col("sequence_number").isNull()).alias("n_missing_sequence"),
        F.avg(spread).alias("spread_mean"),
    ).select("symbol", F.unix_micros("w.start").alias("start_us"), "n_rows", "n_crossed", "n_missing_sequence", "spread_mean")


class LatestUpdate:
    """``foreachBatch`` sink for update mode: every batch keeps its changed groups; ``results`` takes the newest of each."""

    def __init__(self, root: str, keys: list[str]):
        self.root, self.keys = root, keys

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(os.path.join(self.root, f"batch={batch_id}"))

    def results(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(self.root).drop("batch")
        values = [c for c in rows.columns if c not in self.keys and c != "_batch"]
        newest = F.max_by(F.struct(*values), "_batch").alias("_v")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, "_v.*")
