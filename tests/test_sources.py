import os

import pytest
from pyspark.sql import functions as F

from lobwright.operators.clean import SchemaMismatch, check_schema, clean_book, require_columns, validate_book
from lobwright.sources import sink
from lobwright.sources.book import book_columns, events_wide, numeric_levels, pack_levels, unpack_levels, wide_schema
from lobwright.sources.catalogue import day_windows, month_windows
from lobwright.sources.scan import load_snapshots, predicate, read_filtered, row_count
from lobwright.sources.stages import checkpoint_root


def month_files(spark, sf, root):
    from lobwright.sources.sink import typed

    wide = typed(events_wide(spark, sf)).select(*[F.col(f.name).cast(f.dataType) for f in wide_schema().fields])
    for symbol in ("click", "view"):
        d = wide.filter(F.col("symbol") == symbol)
        tmp = os.path.join(root, f"tmp_{symbol}")
        d.coalesce(1).write.parquet(tmp)
        part = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
        os.rename(os.path.join(tmp, part), os.path.join(root, "raw", f"BOOK_SIM_{symbol.upper()}_JAN-2024.parquet"))


def test_scan_prunes_by_name_and_time(spark, sf, tmp_path):
    (tmp_path / "raw").mkdir()
    month_files(spark, sf, str(tmp_path))
    root = str(tmp_path / "raw")
    whole = load_snapshots(spark, root, "SIM", "CLICK")
    assert whole.count() == 210 and set(whole.columns) == set(book_columns())
    part = load_snapshots(spark, root, "SIM", "CLICK", "2024-01-10", "2024-01-20", ["symbol", "bid_0_price"], source_file=True)
    assert 0 < part.count() < 210 and part.columns == ["symbol", "bid_0_price", "source_file", "source_file_size_mb"]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "bid_5_price" not in plan
    empty = load_snapshots(spark, root, "SIM", "CLICK", "2025-03-01", "2025-04-01")
    assert empty.count() == 0 and empty.columns == wide_schema().names
    assert row_count(spark, os.path.join(root, "BOOK_SIM_CLICK_JAN-2024.parquet")) == 210


def test_filters_push_down(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    out = read_filtered(df, [("value", ">", 50.0), ("event_type", "in", ["view"])], ["event_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value)" in plan and "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan
    with pytest.raises(ValueError):
        predicate("x", "~", 1)


def test_wide_files_give_up_only_the_levels_used(spark, sf, tmp_path):
    from lobwright.operators.features import depth_features, price_features

    path = str(tmp_path / "wide")
    events_wide(spark, sf).write.parquet(path)
    wide = numeric_levels(spark.read.parquet(path))
    got = depth_features(price_features(wide), (3,)).select("sequence_number", "depth_imbalance_3", "rel_spread")
    plan = got.select("depth_imbalance_3")._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "bid_2_size" in schema and "bid_3_size" not in schema and "bid_0_price" not in schema
    packed = depth_features(price_features(pack_levels(spark.read.parquet(path))), (3,)).select(*got.columns)
    assert got.exceptAll(packed).count() == 0
    assert clean_book(wide.withColumn("received_time", F.lit(None).cast("string"))).count() == wide.count()
    assert set(unpack_levels(pack_levels(wide)).columns) >= set(book_columns())


def test_schema_contract(spark, sf):
    names = book_columns()
    assert check_schema(names + ["x"]) == {"ok": True, "missing": [], "extra": ["x"]}
    assert check_schema(names[1:])["missing"] == ["origin_time"]
    with pytest.raises(SchemaMismatch):
        require_columns(events_wide(spark, sf), ["nope"])


def test_cleaning_rules(spark):
    def row(i, origin, received, bp=99.0, ap=101.0, bs=1.0, az=1.0, seq=1):
        return (origin, received, seq, "S", "X", [(bp, bs)] * 20, [(ap, az)] * 20)

    rows = [
        row(0, "2024-01-01 00:00:00", None), row(1, None, "2024-01-01 00:00:01"), row(2, "bad", "bad"), row(3, "2024-01-01", None, bp=102.0),
        row(4, "2024-01-01", None, bp=101.0), row(5, "2024-01-01", None, bs=0.0), row(6, "2024-01-01", None, ap=-1.0),
        row(7, "2024-01-01", None, seq=None),
    ]
    df = spark.createDataFrame(rows, "origin_time string, received_time string, sequence_number long, symbol string, exchange string, "
                                     "bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>")
    assert clean_book(df).count() == 4  # two good times, the locked book, the missing sequence
    assert clean_book(df, drop_crossed=False).count() == 5
    assert clean_book(df).filter("sequence_number = -1").count() == 1


def test_strict_validation_can_raise(spark, sf):
    from lobwright.operators.clean import with_event_time
    from lobwright.operators.index import event_index
    from lobwright.sources.book import events_book

    good = event_index(with_event_time(events_book(spark, sf)))
    assert validate_book(good, "error").filter("not ok").count() == 0
    bad = event_index(with_event_time(events_book(spark, sf, defects=True)).filter("event_us is not null"))
    with pytest.raises(ValueError):
        validate_book(bad, "error")


def csv_month(spark, path, header=None):
    names = header or [f.name for f in sink.csv_schema().fields]
    lines = [",".join(names)]
    for i in range(3):
        lines.append(",".join([f"2024-01-01 00:00:0{i}.123456789", "", str(i), "S", "X"] + [str(100.0 + k / 8) for k in range(80)]))
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_csv_conversion_round_trip(spark, tmp_path):
    csv_month(spark, tmp_path / "m.csv")
    target = str(tmp_path / "out")
    rec = sink.convert_csv(spark, str(tmp_path / "m.csv"), target).collect()
    assert [(r.month, r.n_source, r.n_written, r.status) for r in rec] == [("2024-01", 3, 3, "converted")]
    got = spark.read.parquet(target)
    assert got.count() == 3 and got.filter("origin_time is null").count() == 0
    with pytest.raises(FileNotFoundError):
        sink.convert_csv(spark, str(tmp_path / "m.csv"), target, months=["2024-02"])


def test_csv_header_must_match_in_order(spark, tmp_path):
    names = [f.name for f in sink.csv_schema().fields]
    csv_month(spark, tmp_path / "m.csv", [names[1], names[0], *names[2:]])
    with pytest.raises(ValueError):
        sink.convert_csv(spark, str(tmp_path / "m.csv"), str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out")


def test_copy_check_finds_a_changed_value(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0)], "k string, i int, v double")
    b = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.5)], "k string, i int, v double")
    assert sink.compare_tables(a, a, ["k"]).first().status == "converted"
    assert sink.compare_tables(a, b, ["k"]).first().status == "failed"


def test_only_missing_partitions_are_written(spark, tmp_path):
    df = spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, v int")
    path = str(tmp_path / "t")
    assert sink.write_missing(df.filter("day = 'd1'"), path, "day") == 1
    assert sink.write_missing(df, path, "day") == 1
    assert sink.write_missing(df, path, "day") == 0
    assert spark.read.parquet(path).count() == 2


def test_windows(spark):
    us = 86_400_000_000
    lo = 19723 * us  # 2024-01-01
    df = spark.createDataFrame([("S", lo + d * us + 5) for d in range(31)], "symbol string, event_us long")
    w = day_windows(df, 10).orderBy("start_us").collect()
    assert [r.token[:4] for r in w] == ["D001", "D002", "D003", "D004"] and sum(r.n_rows for r in w) == 31
    assert all(a.end_us == b.start_us for a, b in zip(w, w[1:]))
    with pytest.raises(ValueError):
        day_windows(df, 0)
    assert month_windows(["FEB", "DEC"], "2024-02-10", "2025-01-01") == [("FEB", "2024-02-10", "2024-03-01"), ("DEC", "2024-12-01", "2025-01-01")]


def test_stage_folder_follows_the_session(spark):
    class Configured:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "/shared/checkpoints" if key == "spark.checkpoint.dir" else default

    assert checkpoint_root(Configured) == "/shared/checkpoints"
    assert os.path.isabs(checkpoint_root(spark))


def test_time_range_reaches_the_file_source(spark, sf, tmp_path):
    from lobwright.sources.book import events_wide
    from lobwright.sources.scan import in_range
    from lobwright.sources.sink import typed

    rows = typed(events_wide(spark, sf))
    if rows.schema["origin_time"].dataType.simpleString() != "timestamp":
        rows = rows.withColumns({c: F.col(c).try_cast("timestamp") for c in ("origin_time", "received_time")})
    rows.write.parquet(str(tmp_path / "month"))
    got = in_range(spark.read.parquet(str(tmp_path / "month")), "2024-01-05", "2024-01-20 12:00:00")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(origin_time" in plan
    ts = F.coalesce("origin_time", "received_time")
    assert got.count() == rows.filter((ts >= "2024-01-05") & (ts <= "2024-01-20 12:00:00")).count() > 0


def csv_tree(root, months, rows=3, header=None, cell="100.5"):
    names = header or [f.name for f in sink.csv_schema().fields]
    for m in months:
        os.makedirs(root / f"month={m}", exist_ok=True)
        lines = [",".join([f"{m}-01 00:00:{9 - i:02d}.123456789", "", str(i), "S", "X", cell] + ["100.0"] * 79) for i in range(rows)]
        (root / f"month={m}" / f"book_{m}.csv").write_text("\n".join([",".join(names), *lines]) + "\n")


def outcome(records):
    return {r.month: (r.status, r.reason, r.n_source, r.n_written) for r in records.collect()}


def test_months_are_converted_skipped_and_failed(spark, tmp_path):
    from lobwright.sources.convert import convert_months

    source, target = tmp_path / "csv", str(tmp_path / "out")
    csv_tree(source, ["2024-01", "2024-02"])
    csv_tree(source, ["2024-03"], cell="x")
    csv_tree(source, ["2024-04"], header=[f.name for f in sink.csv_schema().fields][::-1])
    csv_tree(source, ["2024-05"], rows=0)
    ok = ("converted", "", 3, 3)
    assert outcome(convert_months(spark, str(source), target, ["2024-01"])) == {"2024-01": ok}
    assert outcome(convert_months(spark, str(source), target)) == {
        "2024-01": ("skipped", "", 3, 3), "2024-02": ok, "2024-03": ("failed", "unreadable lines", 3, 0),
        "2024-04": ("failed", "header", 0, 0), "2024-05": ("failed", "empty", 0, 0)}
    got = spark.read.parquet(target)
    assert got.groupBy("month").count().count() == 2 and got.count() == 6 and got.filter("origin_time is null").count() == 0
    assert sorted(os.listdir(target)) == ["_conversions", "exchange=X"]
    with pytest.raises(FileNotFoundError):
        convert_months(spark, str(source), target, ["2024-01", "2025-01"])


def test_a_changed_month_replaces_what_was_published_and_a_failed_one_does_not(spark, tmp_path):
    import shutil

    from lobwright.sources.convert import convert_months

    source, target = tmp_path / "csv", str(tmp_path / "out")
    csv_tree(source, ["2024-01", "2024-02"])
    convert_months(spark, str(source), target)
    csv_tree(source, ["2024-01"], rows=5)
    csv_tree(source, ["2024-02"], rows=5, cell="x")
    assert outcome(convert_months(spark, str(source), target)) == {
        "2024-01": ("converted", "", 5, 5), "2024-02": ("failed", "unreadable lines", 5, 0)}
    count = lambda m: spark.read.parquet(target).filter(F.col("month") == m).count()
    assert (count("2024-01"), count("2024-02")) == (5, 3)
    shutil.rmtree(os.path.join(target, "exchange=X", "symbol=S", "month=2024-01"))  # rows lost: recorded is not enough
    assert outcome(convert_months(spark, str(source), target, ["2024-01"])) == {"2024-01": ("converted", "", 5, 5)}
    assert outcome(convert_months(spark, str(source), target, ["2024-01"], again=True)) == {"2024-01": ("converted", "", 5, 5)}
    assert outcome(convert_months(spark, str(source), target, ["2024-01"])) == {"2024-01": ("skipped", "", 5, 5)}


def test_audit_by_file_knows_sizes_and_file_order(spark, sf, tmp_path):
    from lobwright.operators.audit import audit_files
    from lobwright.sources.book import events_book
    from lobwright.sources.scan import read_with_origin

    rows = events_book(spark, sf, defects=True).drop("arrival")
    for name, day in (("a", "2024-01-03"), ("b", "2024-01-03"), ("c", "2024-01-04")):
        rows.filter(F.col("origin_time").startswith(day)).coalesce(1).write.parquet(str(tmp_path / f"f={name}"))
    got = audit_files(read_with_origin(spark, str(tmp_path))).withColumn("f", F.regexp_extract("source_file", "f=(.)/", 1))
    twice = got.filter("f = 'a'").drop("f", "source_file").exceptAll(got.filter("f = 'b'").drop("f", "source_file"))
    assert twice.count() == 0 and got.select("f", "trade_date").distinct().count() == 3
    size = os.path.getsize(next(p for p in (tmp_path / "f=a").glob("part-*.parquet"))) / 2**20
    assert {round(r.file_size_mb, 9) for r in got.filter("f = 'a'").collect()} == {round(size, 9)}
