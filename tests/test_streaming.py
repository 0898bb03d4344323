from pyspark.sql import functions as F

from lobwright.plans.chain import book_rows
from lobwright.sources.book import events_book
from lobwright.streaming.live import LiveBook, live_features, run_available


def test_stream_equals_batch_over_restarts_and_late_rows(spark, sf, tmp_path):
    rows = events_book(spark, sf)
    n = rows.count()
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    late = rows.filter("arrival = 3")
    parts = [rows.filter(f"arrival < {n // 2} and arrival <> 3"), rows.filter(f"arrival >= {n // 2}").unionByName(late)]
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        run_available(stream, LiveBook(root), str(tmp_path / "progress"))  # a new query each time, as after a restart
    live = LiveBook(root)
    got = live.results(spark)
    assert got.count() == n - 1 and live.results(spark, "late").count() == 1
    names = ["ofi_5", "realized_vol_20", "spread_z_1m"]
    want = live_features(_reindexed(spark, sf)).select("symbol", "event_idx", *[F.col(c).alias(f"w_{c}") for c in names])
    gap = got.join(want, ["symbol", "event_idx"]).agg(*[F.max(F.abs(F.col(c) - F.col(f"w_{c}"))) for c in names]).first()
    assert max(gap) < 1e-9


def _reindexed(spark, sf):
    from lobwright.operators.index import event_index

    return event_index(book_rows(spark, sf).filter("arrival <> 3").drop("event_idx"))


def test_equal_times_are_placed_by_sequence_and_nothing_is_left_behind(spark, sf, tmp_path):
    import os

    from lobwright.sources.stages import checkpoint_root

    rows = book_rows(spark, sf).filter("symbol = 'click'").drop("event_idx").orderBy("event_us").limit(40).cache()
    last = rows.agg(F.max(F.struct("event_us", "sequence_number")).alias("m")).first()["m"]
    same = rows.filter(F.col("event_us") == last["event_us"]).limit(1)
    higher = same.withColumn("sequence_number", F.lit(last["sequence_number"] + 1))
    live = LiveBook(str(tmp_path / "out"))
    base = os.path.join(checkpoint_root(spark).removeprefix("file:").replace("///", "/"), "lobwright", spark.sparkContext.applicationId)
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    raw = [c for c in rows.columns if c not in ("event_time", "event_us")]
    live(rows.select(raw), 0)
    live(higher.select(raw).unionByName(same.select(raw)), 1)
    assert live.results(spark).count() == 41 and live.results(spark, "late").count() == 1
    assert (set(os.listdir(base)) if os.path.isdir(base) else set()) <= before
    rows.unpersist()
