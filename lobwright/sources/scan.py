"""Snapshot scans: projection, time range and typed filters; what is stored in its own type is filtered by the file source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobwright.sources.book import prepare, wide_schema
from lobwright.sources.catalogue import file_catalogue, filter_catalogue, overlapping

OPERATORS = ("==", "!=", "<", "<=", ">", ">=", "in")


def predicate(column: str, op: str, value) -> Column:
    c = F.col(column)
    if op not in OPERATORS:
        raise ValueError(f"unknown filter operator {op!r}")
    if op == "in":
        return c.isin(list(value))
    return {"==": c == value, "!=": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]


def read_filtered(df: DataFrame, filters=(), columns=None) -> DataFrame:
    """``(column, operator, value)`` filters joined by "and", then a projection."""
    out = reduce(lambda d, f: d.filter(predicate(*f)), filters, df)
    return out.select(*columns) if columns else out


def read_many(spark: SparkSession, pattern: str, schema=None) -> DataFrame:
    """All parquet files matching a glob; an empty match is an error."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(pattern)


def read_with_origin(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet files with where each row stood: ``source_file``, ``source_file_size_mb`` and ``row_index``, from the file source."""
    df = read_many(spark, path, schema)
    return df.select(
        "*", F.col("_metadata.file_path").alias("source_file"), (F.col("_metadata.file_size") / (1024.0 * 1024.0)).alias("source_file_size_mb"),
        F.col("_metadata.row_index").alias("row_index"))


def in_range(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows whose event time (origin, else received) lies in [start, end]; the fallback comes before the filter.

    Where both times are stored as timestamps the predicate names the columns themselves, so that it reaches the file
    source's statistics; times stored as text are parsed first.
    """
    low, high = (None if x is None else F.lit(x).cast("timestamp") for x in (start, end))
    if all(isinstance(df.schema[c].dataType, T.TimestampType) for c in ("origin_time", "received_time")):
        def inside(c: Column) -> Column:
            parts = [c >= low] * (low is not None) + [c <= high] * (high is not None)
            return reduce(lambda a, b: a & b, parts)

        if start is None and end is None:
            return df
        origin, received = F.col("origin_time"), F.col("received_time")
        return df.filter(inside(origin) | (origin.isNull() & inside(received)))
    ts = F.coalesce(F.col("origin_time").try_cast("timestamp"), F.col("received_time").try_cast("timestamp"))
    if start is not None:
        df = df.filter(ts >= low)
    if end is not None:
        df = df.filter(ts <= high)
    return df


def load_snapshots(
    spark: SparkSession, root: str, exchange: str | None = None, symbol: str | None = None, start: str | None = None,
    end: str | None = None, columns=None, source_file: bool = False, levels: int = 20,
) -> DataFrame:
    """Files pruned by month, then columns and time range.  No file left gives an empty, typed table."""
    prepare(spark)
    wanted = overlapping(filter_catalogue(file_catalogue(spark, root), exchange, symbol), start, end)
    paths = [r["file_path"] for r in wanted.select("file_path").collect()]
    schema = wide_schema(levels)
    if not paths:
        return spark.createDataFrame([], schema).select(*(columns or schema.names))
    df = in_range(spark.read.schema(schema).parquet(*paths), start, end)
    extra = []
    if source_file:
        extra = [F.col("_metadata.file_name").alias("source_file"),
                 (F.col("_metadata.file_size") / (1024.0 * 1024.0)).alias("source_file_size_mb")]
    return df.select(*(columns or schema.names), *extra)


def row_count(spark: SparkSession, path: str) -> int:
    """Row count; the vectorised reader takes it from file footers, no column is decoded."""
    return spark.read.parquet(path).count()


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Provider column names to ours; names that are absent are ignored."""
    return df.withColumnsRenamed(mapping)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in the given order: a top-n, not a full sort."""
    return df.orderBy(*order).limit(n)
