"""Registration of queries with their output columns and SQL twins.

A query names its output columns once, as ``name:kind``; the same rounding and casts are then applied to the Spark
result and to the SQL.  Kinds: ``i`` integer, ``s`` text, ``b`` boolean, ``rN`` double rounded to N places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lobwright.plans.oracle import with_blocks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spark(name: str, kind: str) -> str:
    if kind.startswith("r"):
        return f"round(double({name}), {kind[1:]}) + 0D as {name}"
    return f"{ {'i': 'bigint', 's': 'string', 'b': 'boolean'}[kind] }({name}) as {name}"


def _duck(name: str, kind: str) -> str:
    if kind.startswith("r"):
        return f"round({name}::double, {kind[1:]}) + 0e0 as {name}"
    return f"{name}::{ {'i': 'bigint', 's': 'varchar', 'b': 'boolean'}[kind] } as {name}"


def query(name: str, columns: str, sql: str | None = None, extra: dict[str, str] | None = None):
    cols = [tuple(c.split(":")) for c in columns.split()]

    def register(build):
        from lobwright.sources.book import prepare

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return build(spark, sf_dir).selectExpr(*[_spark(*c) for c in cols])

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_blocks(f"select {', '.join(_duck(*c) for c in cols)} from ({sql}) q", extra)
        return build

    return register
