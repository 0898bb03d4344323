"""Sources, cleaning, audits and the event index."""

from __future__ import annotations

from pyspark.sql import functions as F

from lobwright.operators.audit import audit_daily, audit_files, dataset_stats, histogram
from lobwright.operators.clean import clean_book, strict_checks, with_event_time
from lobwright.operators.index import event_index, event_stride
from lobwright.operators.quantiles import group_quantiles
from lobwright.plans import oracle as O
from lobwright.plans.chain import book_rows, indexed_book
from lobwright.plans.registry import query
from lobwright.sources.book import events_book, events_wide, pack_levels, read_events
from lobwright.sources.catalogue import day_windows, filter_catalogue, overlapping, parse_names
from lobwright.sources.scan import first_rows, in_range, read_filtered, read_many, rename
from lobwright.sources.sink import compare_tables, conversion_summary, typed, unsorted_rows
from lobwright.sources.stages import cut

# File names as a provider would have them, one per symbol and day of the data (three month tokens, one unknown).
_NAMES_SQL = """
  select distinct 'BOOK_SIM_' || upper(event_type) || '_' ||
         (case day(ts)::bigint % 4 when 0 then 'JAN' when 1 then 'FEB' when 2 then 'MAR' else 'XXX' end) || '-' ||
         year(ts)::varchar || '.parquet' as file_name from events"""
_PARSED_SQL = f"""
  select file_name, regexp_extract(file_name, 'BOOK_([A-Z0-9]+)_', 1) as exchange,
         split_part(file_name, '_', 3) as symbol, split_part(split_part(file_name, '_', 4), '-', 1) as month,
         split_part(split_part(file_name, '-', 2), '.', 1)::bigint as year,
         case split_part(split_part(file_name, '_', 4), '-', 1) when 'JAN' then '2024-01' when 'FEB' then '2024-02'
              when 'MAR' then '2024-03' end as period from ({_NAMES_SQL})"""
_CAT = "file_name:s exchange:s symbol:s month:s year:i period:s"


def _names(spark, sf):
    return read_events(spark, sf).selectExpr(
        "concat('BOOK_SIM_', upper(event_type), '_', case day(ts) % 4 when 0 then 'JAN' when 1 then 'FEB' "
        "when 2 then 'MAR' else 'XXX' end, '-', string(year(ts)), '.parquet') as file_name"
    ).distinct()


@query("s1_file_catalogue", _CAT, _PARSED_SQL)
def _(spark, sf):
    return parse_names(_names(spark, sf))


@query("s2_catalogue_filter", _CAT, f"select * from ({_PARSED_SQL}) where exchange = 'SIM' and symbol = 'CLICK'")
def _(spark, sf):
    return filter_catalogue(parse_names(_names(spark, sf)), "SIM", "CLICK")


@query("s3_month_overlap", _CAT,
       f"select * from ({_PARSED_SQL}) where period is null or period in ('2024-02', '2024-03')")
def _(spark, sf):
    return overlapping(parse_names(_names(spark, sf)), "2024-02-10", "2024-03-05")


@query("s4_snapshot_scan", "symbol:s arrival:i bid_0_price:r6 ask_0_price:r6",
       """select symbol, arrival, bids[1].price as bid_0_price, asks[1].price as ask_0_price from bad_t
          where event_time >= timestamp '2024-01-05' and event_time <= timestamp '2024-01-20 12:00:00'""")
def _(spark, sf):
    return in_range(events_wide(spark, sf, defects=True), "2024-01-05", "2024-01-20 12:00:00")


@query("s4b_month_files", "arrival:i bid_0_price:r4 ask_0_price:r4 source_file:s has_size:b",
       """select arrival, bids[1].price as bid_0_price, asks[1].price as ask_0_price, 'BOOK_SIM_CLICK_MAR-2024.parquet' as source_file, true as has_size
          from raw where symbol = 'click' and arrival % 2 = 1 and try_cast('2024-03' || substr(origin_time, 8) as timestamp)
                between timestamp '2024-03-05' and timestamp '2024-03-20 12:00:00'""")
def _(spark, sf):
    """Two months of every symbol as provider files; the loader prunes files by name, then columns and times in the file source."""
    from lobwright.sources.book import wide_schema
    from lobwright.sources.scan import load_snapshots
    from lobwright.sources.stages import new_path

    root = new_path(spark, "month_files")
    moved = [F.when(F.col("arrival") % 2 == 1, F.concat(F.lit("2024-03"), F.substring(c, 8, 19))).otherwise(F.col(c)).alias(c)
             for c in ("origin_time", "received_time")]
    wide = events_wide(spark, sf)
    rows = wide.select(*moved, *[c for c in wide.columns if c not in ("origin_time", "received_time")])
    stamped = rows.withColumns({c: F.try_to_timestamp(F.col(c)) for c in ("origin_time", "received_time")}).select(
        *[F.col(f.name).cast(f.dataType) for f in wide_schema().fields],
        F.concat(F.lit("BOOK_SIM_"), F.upper("symbol"), F.when(F.col("arrival") % 2 == 1, "_MAR").otherwise("_JAN"), F.lit("-2024.parquet")).alias("name"))
    stamped.repartition("name").write.partitionBy("name").parquet(f"{root}/parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{root}/raw"))
    for part in fs.globStatus(path(f"{root}/parts/name=*/part-*")):
        fs.rename(part.getPath(), path(f"{root}/raw/" + part.getPath().getParent().getName().split("=")[1]))
    got = load_snapshots(spark, f"{root}/raw", "SIM", "CLICK", "2024-03-05", "2024-03-20 12:00:00",
                         ["sequence_number", "bid_0_price", "ask_0_price"], source_file=True)
    return got.selectExpr("sequence_number as arrival", "bid_0_price", "ask_0_price", "source_file", "source_file_size_mb > 0 as has_size")


@query("s5_multi_file_read", "symbol:s n_rows:i size_sum:r4",
       "select symbol, count(*) as n_rows, sum(asks[1].size) as size_sum from raw group by symbol")
def _(spark, sf):
    wide = events_wide(spark, sf)
    path = cut(wide, "parts").inputFiles()[0].rsplit("/", 1)[0]
    back = pack_levels(read_many(spark, path + "/*.parquet", wide.schema))
    return back.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.expr("sum(asks[0].size) as size_sum"))


@query("s6_filtered_read", "arrival:i symbol:s bid_0_size:r4",
       """select arrival, symbol, bids[1].size as bid_0_size from raw
          where symbol in ('click', 'view') and bids[1].size >= 5 and arrival <> 17""")
def _(spark, sf):
    filters = [("symbol", "in", ["click", "view"]), ("bid_0_size", ">=", 5.0), ("arrival", "!=", 17)]
    return read_filtered(events_wide(spark, sf), filters, ["arrival", "symbol", "bid_0_size"])


@query("s7_row_count", "n_rows:i", "select count(*) as n_rows from events")
def _(spark, sf):
    return read_events(spark, sf).agg(F.count("*").alias("n_rows"))


@query("s8_write_formats", "format:s symbol:s n_rows:i value_sum:r4",
       """select f.format, event_type as symbol, count(*) as n_rows, sum(value) as value_sum
          from events cross join (select unnest(['parquet', 'csv', 'json']) as format) f group by 1, 2""")
def _(spark, sf):
    import os

    from lobwright.sources.sink import write_table
    from lobwright.sources.stages import checkpoint_root

    ev = read_events(spark, sf).selectExpr("event_id", "event_type as symbol", "value")
    root = os.path.join(checkpoint_root(spark), "lobwright", spark.sparkContext.applicationId, f"fmt-{os.urandom(4).hex()}")
    out = None
    for fmt in ("parquet", "csv", "json"):
        write_table(ev, f"{root}/{fmt}", fmt)
        reader = spark.read.schema(ev.schema)
        back = (reader.option("header", True).csv if fmt == "csv" else getattr(reader, fmt))(f"{root}/{fmt}")
        agg = back.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.sum("value").alias("value_sum"))
        agg = agg.withColumn("format", F.lit(fmt))
        out = agg if out is None else out.unionByName(agg)
    return out


@query("s9_merge_parts", "symbol:s n_rows:i first_id:i last_id:i",
       "select event_type as symbol, count(*) as n_rows, min(event_id) as first_id, max(event_id) as last_id from events group by 1")
def _(spark, sf):
    import os

    from lobwright.sources.sink import merge_parts
    from lobwright.sources.stages import checkpoint_root

    root = os.path.join(checkpoint_root(spark), "lobwright", spark.sparkContext.applicationId, f"merge-{os.urandom(4).hex()}")
    ev = read_events(spark, sf).selectExpr("event_id", "event_type as symbol", "value")
    ev.filter("event_id % 2 = 0").write.parquet(f"{root}/a")
    ev.filter("event_id % 2 = 1").withColumn("value", F.col("value").cast("float")).write.parquet(f"{root}/b")
    merged = merge_parts(spark, [f"{root}/a", f"{root}/b"], f"{root}/merged")
    return merged.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


_UNSORTED_SQL = """
  select exchange, symbol, month, count(*) as n_rows, count(*) filter (where po is not null and (o, r, s) < (po, pr, ps)) as n_unsorted
  from (select *, lag(o) over w as po, lag(r) over w as pr, lag(s) over w as ps
        from (select exchange, symbol, arrival, coalesce(strftime(event_time, '%Y-%m'), 'unknown') as month,
                     coalesce(epoch_us(try_cast(origin_time as timestamp)), -1) as o,
                     coalesce(epoch_us(try_cast(received_time as timestamp)), -1) as r,
                     coalesce(sequence_number, -1) as s from bad_t)
        window w as (partition by exchange, symbol, month order by arrival))
  group by 1, 2, 3"""


def _arrivals(spark, sf):
    """Rows with their dense position in the (symbol, month) file."""
    rows = typed(events_book(spark, sf, defects=True).drop("bids", "asks"))
    return event_index(rows.withColumn("file_order", F.col("arrival")), ("exchange", "symbol", "month"),
                       time_col="file_order", seq_col="file_order").withColumn("arrival", F.col("event_idx"))


@query("s10_conversion_order", "exchange:s symbol:s month:s n_rows:i n_unsorted:i", _UNSORTED_SQL)
def _(spark, sf):
    return unsorted_rows(_arrivals(spark, sf))


_CSV_SQL = """
  select exchange, symbol, strftime(event_time, '%Y-%m') as month, count(*) as n_source, count(*) as n_written,
         'converted' as status from raw_t group by 1, 2, 3"""


@query("s11_written_copy_check", "exchange:s symbol:s month:s n_source:i n_written:i status:s", _CSV_SQL)
def _(spark, sf):
    rows = typed(events_wide(spark, sf))
    return compare_tables(rows, cut(rows, "copy"), ["exchange", "symbol", "month"])


@query("s12_conversion_summary", "n_converted:i n_failed:i n_skipped:i n_rows:i decision:s",
       f"""select count(*) as n_converted, 0 as n_failed, 0 as n_skipped, sum(n_source) as n_rows, 'PASS' as decision
           from ({_CSV_SQL})""")
def _(spark, sf):
    rows = typed(events_wide(spark, sf))
    return conversion_summary(compare_tables(rows, cut(rows, "copy"), ["exchange", "symbol", "month"]))


_CSV_MONTHS = ("2024-01", "2024-03", "2024-05", "2024-07", "2024-08")
_MONTHS_SQL = f"""
  select [{", ".join(f"'{m}'" for m in _CSV_MONTHS)}][arrival % 5 + 1] as month, count(*) as n, count(*) filter (where arrival % 50 = 3) as n_bad
  from raw group by 1"""
_JOB_SQL = f"""
  select month, case month when '2024-01' then 'skipped' when '2024-05' then 'failed' when '2024-07' then case when n_bad > 0 then 'failed' else 'converted' end
              else 'converted' end as status,
         case when month = '2024-05' then 'header' when month = '2024-07' and n_bad > 0 then 'unreadable lines' else '' end as reason,
         case when month = '2024-05' then 0 else n end as n_source,
         case when month = '2024-05' or (month = '2024-07' and n_bad > 0) then 0 else n end as n_written,
         month <> '2024-05' and not (month = '2024-07' and n_bad > 0) as published
  from ({_MONTHS_SQL})"""


def _conversion(spark, sf):
    """Every event as a line of one of five months: one converted before, one under another header, one with lines that can't be read."""
    import os

    from lobwright.sources.convert import convert_months
    from lobwright.sources.sink import csv_schema
    from lobwright.sources.stages import new_path

    root = new_path(spark, "csv_job")
    month = F.element_at(F.array(*map(F.lit, _CSV_MONTHS)), F.col("arrival").cast("int") % 5 + 1)
    wide = events_wide(spark, sf).withColumn("month", month)
    rows = wide.withColumns({
        **{c: F.concat("month", F.substring(c, 8, 19)) for c in ("origin_time", "received_time")},
        "ask_7_size": F.when((F.col("month") == "2024-07") & (F.col("arrival") % 50 == 3), "n/a").otherwise(F.col("ask_7_size").cast("string")),
    }).select(*csv_schema().names, "month")
    even, odd = os.path.join(root, "csv", "a"), os.path.join(root, "csv", "b")
    rows.filter("month <> '2024-05'").write.option("header", True).partitionBy("month").csv(even)
    renamed = rows.filter("month = '2024-05'").withColumnRenamed("bid_3_size", "bid_3_amount")
    renamed.write.option("header", True).partitionBy("month").csv(odd)
    convert_months(spark, os.path.join(root, "csv"), os.path.join(root, "out"), months=["2024-01"])
    return convert_months(spark, os.path.join(root, "csv"), os.path.join(root, "out")), os.path.join(root, "out")


@query("s10b_conversion_job", "month:s status:s reason:s n_source:i n_written:i published:b", _JOB_SQL)
def _(spark, sf):
    """The records of the second run, and whether the target holds the month with just the rows recorded."""
    records, target = _conversion(spark, sf)
    stored = spark.read.parquet(target).groupBy("month").agg(F.count("*").alias("n_stored"))
    return records.join(stored, "month", "left").withColumn("published", F.coalesce(F.col("n_stored") == F.col("n_written"), F.lit(False)))


@query("s12b_conversion_job_summary", "n_converted:i n_failed:i n_skipped:i n_rows:i has_bytes:b decision:s",
       f"""select count(*) filter (where status = 'converted') as n_converted, count(*) filter (where status = 'failed') as n_failed,
                  count(*) filter (where status = 'skipped') as n_skipped, sum(n_source) as n_rows, true as has_bytes,
                  case when count(*) filter (where status = 'failed') = 0 then 'PASS' else 'FAIL' end as decision from ({_JOB_SQL})""")
def _(spark, sf):
    return conversion_summary(_conversion(spark, sf)[0]).withColumn("has_bytes", F.col("n_bytes") > 0)


@query("s13_time_windows", "symbol:s token:s start_us:i end_us:i n_rows:i",
       """select symbol, 'D' || lpad((i + 1)::varchar, 3, '0') || '_' || strftime(make_timestamp(lo + i * 864000000000), '%Y%m%d')
                 || '_' || strftime(make_timestamp(lo + (i + 1) * 864000000000 - 1), '%Y%m%d') as token,
                 lo + i * 864000000000 as start_us, lo + (i + 1) * 864000000000 as end_us,
                 (select count(*) from raw_t r where r.symbol = p.symbol and r.event_us >= lo + i * 864000000000
                     and r.event_us < lo + (i + 1) * 864000000000) as n_rows
          from (select symbol, lo, unnest(range(0, (hi - lo) // 864000000000 + 1)) as i
                from (select symbol, min(event_us) // 86400000000 * 86400000000 as lo, max(event_us) as hi
                      from raw_t group by 1)) p""")
def _(spark, sf):
    return day_windows(with_event_time(events_book(spark, sf)), 10)


@query("s14_missing_partitions", "trade_date:s n_rows:i added:i",
       """select strftime(event_time, '%Y-%m-%d') as trade_date, count(*) as n_rows,
                 max(case when event_time >= timestamp '2024-01-16' then 1 else 0 end) as added from raw_t group by 1""")
def _(spark, sf):
    import os

    from lobwright.sources.sink import write_missing
    from lobwright.sources.stages import checkpoint_root

    root = os.path.join(checkpoint_root(spark), "lobwright", spark.sparkContext.applicationId, f"days-{os.urandom(4).hex()}")
    ev = read_events(spark, sf).selectExpr("event_id", "date_format(cast(ts as timestamp), 'yyyy-MM-dd') as trade_date")
    write_missing(ev.filter("trade_date < '2024-01-16'").withColumn("added", F.lit(0)), root, "trade_date")
    write_missing(ev.withColumn("added", F.lit(1)), root, "trade_date")
    back = spark.read.parquet(root)
    return back.groupBy(F.expr("date_format(trade_date, 'yyyy-MM-dd') as trade_date")).agg(
        F.count("*").alias("n_rows"), F.max("added").alias("added")
    )


@query("s15_rename_columns", "sequence_number:i symbol:s price:r4",
       "select event_id as sequence_number, event_type as symbol, value as price from events")
def _(spark, sf):
    return rename(read_events(spark, sf), {"event_id": "sequence_number", "event_type": "symbol", "value": "price", "absent": "x"})


@query("s16_sample_extract", "arrival:i symbol:s", "select arrival, symbol from raw order by symbol, arrival limit 50")
def _(spark, sf):
    return first_rows(events_book(spark, sf), ["symbol", "arrival"], 50)


@query("s17_synthetic_book", "symbol:s n_rows:i mid_mean:r6 spread_mean:r6 size_sum:r3",
       """select symbol, count(*) as n_rows, avg((bids[1].price + asks[1].price) / 2) as mid_mean,
                 avg(asks[1].price - bids[1].price) as spread_mean,
                 sum(list_sum(list_transform(bids, lambda l: l.size)) + list_sum(list_transform(asks, lambda l: l.size))) as size_sum
          from raw group by symbol""")
def _(spark, sf):
    return events_book(spark, sf).groupBy("symbol").agg(
        F.count("*").alias("n_rows"),
        F.expr("avg((bids[0].price + asks[0].price) / 2) as mid_mean"),
        F.expr("avg(asks[0].price - bids[0].price) as spread_mean"),
        F.expr("sum(aggregate(bids, 0D, (s, l) -> s + l.size) + aggregate(asks, 0D, (s, l) -> s + l.size)) as size_sum"),
    )


# ---------------------------------------------------------------- cleaning and audits

@query("c1_schema_check", "table_form:s ok:b n_missing:i n_extra:i n_rows:i",
       """select 'wide' as table_form, true as ok, 0 as n_missing, 1 as n_extra, count(*) as n_rows from events
          union all select 'narrow', false, 80, 3, count(*) from events""")
def _(spark, sf):
    """The wide form satisfies the contract, with one extra column; the array form lacks all level columns."""
    from lobwright.operators.clean import check_schema

    out = None
    for form, df in (("wide", events_wide(spark, sf)), ("narrow", events_book(spark, sf))):
        c = check_schema(df.columns)
        row = df.agg(F.count("*").alias("n_rows")).selectExpr(
            f"'{form}' as table_form", f"{str(c['ok']).lower()} as ok", f"{len(c['missing'])} as n_missing",
            f"{len(c['extra'])} as n_extra", "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("c2_event_time", "arrival:i event_us:i", "select arrival, event_us from bad_t")
def _(spark, sf):
    return with_event_time(events_book(spark, sf, defects=True))


@query("c3_clean_book", "arrival:i symbol:s event_us:i sequence_number:i event_idx:i best_bid:r6 best_ask:r6",
       "select *, bids[1].price as best_bid, asks[1].price as best_ask from book_bad")
def _(spark, sf):
    rows = book_rows(spark, sf, defects=True)
    return rows.selectExpr("*", "bids[0].price as best_bid", "asks[0].price as best_ask")


@query("c3b_clean_keep_crossed", "symbol:s n_rows:i n_crossed:i",
       "select symbol, count(*) as n_rows, count(*) filter (where bids[1].price > asks[1].price) as n_crossed from kept group by 1",
       extra={"kept": O.clean("bad_t", drop_crossed=False)})
def _(spark, sf):
    return clean_book(events_book(spark, sf, defects=True), drop_crossed=False).groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.expr("count_if(bids[0].price > asks[0].price) as n_crossed")
    )


_AUDIT_COLS = (
    "exchange:s symbol:s trade_date:s n_rows:i first_us:i last_us:i duration_seconds:r6 mean_snapshot_interval_ms:r6 "
    "p50_snapshot_interval_ms:r6 p95_snapshot_interval_ms:r6 p99_snapshot_interval_ms:r6 n_duplicate_timestamps:i "
    "n_duplicate_sequence_numbers:i n_non_monotonic_sequence:i n_missing_values_by_column:s n_crossed_book_rows:i "
    "n_zero_or_negative_price_rows:i n_zero_or_negative_size_rows:i spread_mean:r6 spread_p50:r6 spread_p95:r6 "
    "depth_top10_mean:r6 depth_top10_p50:r6 depth_top10_p95:r6"
)
_AUDIT_BLOCKS = {
    "aud_rows": """
      select *, lag(event_us) over w as before_us, lag(sequence_number) over w as before_seq
      from (select *, coalesce(strftime(event_time, '%Y-%m-%d'), 'NaT') as trade_date, asks[1].price - bids[1].price as spread,
                   coalesce(list_sum(list_transform(bids[1:10], lambda l: l.size)), 0)
                     + coalesce(list_sum(list_transform(asks[1:10], lambda l: coalesce(l.size, 0))), 0) as depth
            from bad_t)
      window w as (partition by exchange, symbol, trade_date order by event_us nulls first, sequence_number nulls first, arrival)""",
    "aud": """
      select exchange, symbol, trade_date, count(*) as n_rows, min(event_us) as first_us, max(event_us) as last_us,
             (max(event_us) - min(event_us)) / 1e6 as duration_seconds,
             coalesce(avg((event_us - before_us) / 1e3), 0) as mean_snapshot_interval_ms,
             coalesce(quantile_cont((event_us - before_us) / 1e3, 0.5), 0) as p50_snapshot_interval_ms,
             coalesce(quantile_cont((event_us - before_us) / 1e3, 0.95), 0) as p95_snapshot_interval_ms,
             coalesce(quantile_cont((event_us - before_us) / 1e3, 0.99), 0) as p99_snapshot_interval_ms,
             count(*) - count(distinct coalesce(event_us, -1)) as n_duplicate_timestamps,
             count(*) - count(distinct coalesce(sequence_number, -999)) as n_duplicate_sequence_numbers,
             count(*) filter (where sequence_number < before_seq) as n_non_monotonic_sequence,
             '{' || concat_ws(',', case when count(*) filter (where asks[4].size is null) > 0 then '"ask_3_size":' ||
                     (count(*) filter (where asks[4].size is null))::varchar end,
                   case when count(*) filter (where event_us is null) > 0 then '"event_time":' ||
                     (count(*) filter (where event_us is null))::varchar end,
                   case when count(*) filter (where sequence_number is null) > 0 then '"sequence_number":' ||
                     (count(*) filter (where sequence_number is null))::varchar end) || '}' as n_missing_values_by_column,
             count(*) filter (where bids[1].price > asks[1].price) as n_crossed_book_rows,
             count(*) filter (where list_min(list_transform(bids, lambda l: l.price)) <= 0
                                 or list_min(list_transform(asks, lambda l: l.price)) <= 0) as n_zero_or_negative_price_rows,
             count(*) filter (where list_min(list_transform(bids, lambda l: l.size)) <= 0
                                 or list_min(list_transform(asks, lambda l: l.size)) <= 0) as n_zero_or_negative_size_rows,
             avg(spread) as spread_mean, quantile_cont(spread, 0.5) as spread_p50, quantile_cont(spread, 0.95) as spread_p95,
             avg(depth) as depth_top10_mean, quantile_cont(depth, 0.5) as depth_top10_p50,
             quantile_cont(depth, 0.95) as depth_top10_p95
      from aud_rows group by 1, 2, 3""",
}


def _audit(spark, sf):
    """Audited rows are ordered by (event time, sequence); rows without any time are a group of their own."""
    return audit_daily(event_index(with_event_time(events_book(spark, sf, defects=True)), missing_time=True))


@query("c4_daily_audit", _AUDIT_COLS, "select * from aud", extra=_AUDIT_BLOCKS)
def _(spark, sf):
    return _audit(spark, sf)


_FILE_BLOCKS = {
    "aud_rows": _AUDIT_BLOCKS["aud_rows"].replace("from bad_t", "from (select *, arrival % 3 as piece from bad_t)").replace(
        "partition by exchange, symbol, trade_date", "partition by exchange, symbol, piece, trade_date"),
    "aud": _AUDIT_BLOCKS["aud"].replace("select exchange, symbol, trade_date", "select exchange, symbol, piece, trade_date").replace(
        "group by 1, 2, 3", "group by 1, 2, 3, 4"),
}


@query("c4b_file_audit", "piece:i has_size:b " + _AUDIT_COLS, "select *, true as has_size from aud", extra=_FILE_BLOCKS)
def _(spark, sf):
    """The faulty book in three files, audited file by file."""
    from lobwright.sources.scan import read_with_origin
    from lobwright.sources.stages import new_path

    path = new_path(spark, "audited_files")
    rows = events_book(spark, sf, defects=True).withColumn("piece", F.col("arrival") % 3)
    rows.repartition("piece").write.partitionBy("piece").parquet(path)
    audit = audit_files(read_with_origin(spark, path))
    return audit.withColumns({"piece": F.regexp_extract("source_file", "piece=([0-9]+)/", 1), "has_size": F.col("file_size_mb") > 0})


@query("c5_dataset_stats",
       "exchange:s symbol:s rows:i days:i median_snapshot_interval_ms:r6 mean_spread:r6 mean_depth_top10:r6 "
       "first_us:i last_us:i source_audit_artifact:s",
       """select exchange, symbol, sum(n_rows) as rows, count(distinct trade_date) as days,
                 quantile_cont(p50_snapshot_interval_ms, 0.5) as median_snapshot_interval_ms, avg(spread_mean) as mean_spread,
                 avg(depth_top10_mean) as mean_depth_top10, min(first_us) as first_us, max(last_us) as last_us,
                 case when count(distinct trade_date <= '2024-01-20') > 1 then 'first;second'
                      when max(trade_date) <= '2024-01-20' then 'first' else 'second' end as source_audit_artifact
          from aud group by 1, 2""", extra=_AUDIT_BLOCKS)
def _(spark, sf):
    """Two overlapping audit sources: the first covers the days to the 20th, the second all days."""
    audit = cut(_audit(spark, sf), "audit")
    first = audit.filter("trade_date <= '2024-01-20'").selectExpr("*", "0 as source_priority", "'first' as source")
    second = audit.selectExpr("*", "1 as source_priority", "'second' as source")
    return dataset_stats(first.unionByName(second))


@query("c6_strict_validation",
       "symbol:s n_rows:i n_bad_time:i n_time_backwards:i n_touching_best:i n_negative_size:i n_bid_unsorted:i "
       "n_ask_unsorted:i n_duplicate_times:i ok:b",
       """select *, n_bad_time + n_time_backwards + n_touching_best + n_negative_size + n_bid_unsorted + n_ask_unsorted = 0 as ok
          from (select symbol, count(*) as n_rows, count(*) filter (where event_us is null) as n_bad_time,
                 count(*) filter (where event_us < before) as n_time_backwards,
                 count(*) filter (where not bids[1].price < asks[1].price) as n_touching_best,
                 count(*) filter (where list_min(list_transform(bids, lambda l: l.size)) < 0
                                     or list_min(list_transform(asks, lambda l: l.size)) < 0) as n_negative_size,
                 count(*) filter (where list_reverse_sort(list_transform(bids, lambda l: l.price))
                                        <> list_transform(bids, lambda l: l.price)) as n_bid_unsorted,
                 count(*) filter (where list_sort(list_transform(asks, lambda l: l.price))
                                        <> list_transform(asks, lambda l: l.price)) as n_ask_unsorted,
                 count(event_us) - count(distinct event_us) as n_duplicate_times
                from (select *, lag(event_us) over (partition by symbol order by arrival) as before from bad_t) group by 1)""")
def _(spark, sf):
    rows = with_event_time(events_book(spark, sf, defects=True)).withColumn("file_order", F.col("arrival"))
    return strict_checks(event_index(rows, time_col="file_order", seq_col="file_order"))


@query("c7_spread_histogram", "symbol:s bin:i n:i",
       """select symbol, least(floor(round((v - lo) / ((hi - lo) / 50e0), 9)), 49) as bin, count(*) as n
          from (select symbol, spread as v, min(spread) over (partition by symbol) as lo,
                       max(spread) over (partition by symbol) as hi
                from (select symbol, round(asks[1].price - bids[1].price, 9) as spread from book)) group by 1, 2""")
def _(spark, sf):
    return histogram(indexed_book(spark, sf), F.expr("round(asks[0].price - bids[0].price, 9)"))


@query("c7b_interval_quantiles", "symbol:s p05:r6 p50:r6 p95:r6",
       """select symbol, quantile_cont(g, 0.05) as p05, quantile_cont(g, 0.5) as p50, quantile_cont(g, 0.95) as p95
          from (select symbol, (event_us - lag(event_us) over (partition by symbol order by event_idx)) / 1e3 as g from book)
          group by 1""")
def _(spark, sf):
    from lobwright.operators.chunks import chunk_window, drop_halo, with_halo

    d = with_halo(indexed_book(spark, sf).select("exchange", "symbol", "event_idx", "event_us"), back=1)
    d = drop_halo(d.withColumn("g", (F.col("event_us") - F.lag("event_us").over(chunk_window())) / 1000.0))
    return group_quantiles(d, ["symbol"], {f"p{int(q * 100):02d}": (F.col("g"), q) for q in (0.05, 0.5, 0.95)})


@query("i1_event_index", "symbol:s arrival:i event_idx:i", "select symbol, arrival, event_idx from book")
def _(spark, sf):
    return book_rows(spark, sf)


@query("i1b_index_with_ties", "symbol:s arrival:i event_idx:i",
       """select symbol, arrival, row_number() over (partition by exchange, symbol
                   order by second_us nulls first, sequence_number nulls first, arrival) - 1 as event_idx
          from (select *, (event_us // 60000000) * 60000000 as second_us from bad_t)""")
def _(spark, sf):
    """Every row of the faulty book, times cut to minutes: ties in time, missing sequences and rows without a time."""
    rows = with_event_time(events_book(spark, sf, defects=True)).withColumn("minute_us", F.expr("event_us div 60000000 * 60000000"))
    return event_index(rows.drop("bids", "asks"), time_col="minute_us", missing_time=True)


@query("f11_event_stride", "symbol:s arrival:i event_idx:i", "select symbol, arrival, event_idx from book where event_idx % 7 = 0")
def _(spark, sf):
    return event_stride(indexed_book(spark, sf), 7)
