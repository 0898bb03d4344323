"""Registered queries against their SQL twins on the smallest tables, and properties of their plans."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_queries import TABLES, canon  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from lobwright.plans import catalog  # noqa: E402

SLOW = ("x1", "x2", "x3", "x4", "m3", "m4", "m4b", "r10")
# The smallest tables leave no validation rows after the purge; what needs trades runs one size up.
LARGER = ("b", "t", "g", "h", "j", "f13", "k7", "k8", "e8", "f9", "f10", "m5b", "m6")
LARGER_SF = "/root/testdata/sf0.01"
NAMES = [n for n in catalog.QUERIES if n.split("_")[0] not in SLOW]  # the training-data package has tests of its own


@pytest.fixture(scope="module")
def duck(sf):
    def connect(folder):
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
        return con

    return {folder: connect(folder) for folder in {sf, LARGER_SF}}


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    folder = LARGER_SF if name.startswith(LARGER) else sf
    df = entry.queries()[name](spark, folder)
    rel = duck[folder].execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    assert got and got == canon(rel.fetchall(), names)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sequence_windows_are_chunked(spark, sf):
    """No window over rows is partitioned by symbol alone, and all feature windows share one exchange."""
    from lobwright.operators.features import depth_features, distance_features, price_features, sequence_features
    from lobwright.plans.chain import indexed_book

    columns = ("symbol", "event_idx", "vol_score", "ofi_10", "return_autocorr_500", "depth_drop_top10")
    df = sequence_features(distance_features(depth_features(price_features(indexed_book(spark, sf)))), columns=columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    specs = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert specs and all("_chunk" in line for line in specs)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("+- Sort") + plan.count("- *(2) Sort") <= 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
