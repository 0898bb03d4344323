"""The chain sorts, shuffles and stores quotes, not the forty levels that follow from them."""

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobwright.operators.chunks import ChunkSql, drop_halo, with_halo
from lobwright.operators.features import order_flow
from lobwright.operators.fills import Execution, round_trips
from lobwright.operators.quantiles import group_quantiles
from lobwright.plans.chain import EXECUTION, indexed_book, labelled_features, scored
from lobwright.sources import stages
from lobwright.sources.book import unpack_levels


def test_stored_stages_hold_no_levels(spark, sf):
    rows = scored(spark, sf)
    assert {"bids", "asks"} <= set(rows.columns)
    mine = {name: schema for (app, scope, name), (_, schema) in stages._written.items()
            if scope == sf and app == spark.sparkContext.applicationId and name in ("book", "labelled", "regimed", "scored")}
    assert set(mine) == {"book", "labelled", "regimed", "scored"}
    for name, schema in mine.items():
        assert not any(isinstance(f.dataType, T.ArrayType) for f in schema.fields), name


def test_no_levels_go_through_the_feature_exchange(spark, sf):
    plan = labelled_features(indexed_book(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "struct<price" not in plan and "named_struct(price" not in plan


def test_order_flow_is_the_same_from_wide_columns(spark, sf):
    book, win, names = indexed_book(spark, sf), ChunkSql(), ["symbol", "event_idx", "ofi_1", "ofi_5"]
    a = drop_halo(order_flow(with_halo(book, back=1), win, (1, 5))).select(*names)
    b = drop_halo(order_flow(with_halo(unpack_levels(book, 5), back=1), win, (1, 5))).select(*names)
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def test_fills_are_the_same_with_levels_derived_after_the_join(spark, sf):
    rows = scored(spark, sf)
    signals = rows.select("exchange", "symbol", "event_idx", F.when(F.col("event_idx") % 2 == 0, 1).otherwise(-1).alias("action"))
    a, b = round_trips(signals, rows, Execution(hold=5)), round_trips(signals, rows, replace(EXECUTION, hold=5))
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def test_quantiles_of_more_rows_than_a_task_should_hold_are_counted(spark):
    df = spark.range(250_002).selectExpr("'k' as k", "double(id) as v")
    got = group_quantiles(df, ["k"], {"q": (F.col("v"), 0.5)})
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first()["q"] == 125_000.5
