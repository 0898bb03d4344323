"""Writing tables: formats, merged parts, CSV conversion with validation, incremental partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobwright.functions.scalars import KEYS
from lobwright.operators.chunks import CHUNK_ROWS, chunk_window, drop_halo, with_halo
from lobwright.sources.book import wide_schema

PARTITIONS = ("exchange", "symbol", "month")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=()) -> None:
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def merge_parts(spark: SparkSession, parts: list[str], target: str) -> DataFrame:
    """All parts in the first part's schema, published by one commit."""
    schema = spark.read.parquet(parts[0]).schema
    merged = None
    for part in parts:
        df = spark.read.parquet(part)
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        merged = df if merged is None else merged.unionByName(df)
    merged.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def csv_schema(levels: int = 20) -> T.StructType:
    """Timestamps stay text so that values finer than a microsecond still parse."""
    text = T.StringType()
    return T.StructType(
        [T.StructField(f.name, text if f.name.endswith("_time") else f.dataType) for f in wide_schema(levels).fields]
    )


def check_header(spark: SparkSession, path: str, levels: int = 20) -> None:
    """The header must hold the expected names in the expected order."""
    for row in spark.read.text(path, wholetext=False).limit(1).collect():
        names = row[0].split(",")
        want = [f.name for f in csv_schema(levels).fields]
        if names != want:
            wrong = [(a, b) for a, b in zip(names, want) if a != b][:3] or [(len(names), len(want))]
            raise ValueError(f"unexpected CSV header, first differences {wrong}")


def typed(df: DataFrame) -> DataFrame:
    """Text timestamps, naive ones taken as UTC, to timestamps; the month each row belongs to."""
    out = df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in ("origin_time", "received_time")})
    event = F.coalesce("origin_time", "received_time")
    return out.withColumn("month", F.coalesce(F.date_format(event, "yyyy-MM"), F.lit("unknown")))


def unsorted_rows(df: DataFrame, arrival: str = "arrival", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per symbol and month the rows that come before their predecessor in (origin, received, sequence).

    ``arrival`` is the dense position in the file; positions are cut into chunks, so no month is one task.
    """
    w = chunk_window((*KEYS, "month"), arrival)
    key = F.struct(
        F.coalesce(F.unix_micros("origin_time"), F.lit(-1)).alias("o"),
        F.coalesce(F.unix_micros("received_time"), F.lit(-1)).alias("r"),
        F.coalesce("sequence_number", F.lit(-1)).alias("s"),
    )
    rows = df.select(*KEYS, "month", arrival, key.alias("_k"))
    stepped = drop_halo(
        with_halo(rows, back=1, chunk_rows=chunk_rows, idx=arrival).withColumn("_p", F.lag("_k").over(w))
    )
    return stepped.groupBy(*KEYS, "month").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("_k") < F.col("_p")).alias("n_unsorted")
    )


def convert_csv(spark: SparkSession, source: str, target: str, levels: int = 20, months=None, skip=()) -> DataFrame:
    """CSV months to sorted, partitioned parquet; one record per (exchange, symbol, month).

    The result is written to a side folder, compared with the source, and published only if they agree.
    """
    check_header(spark, source, levels)
    rows = typed(spark.read.schema(csv_schema(levels)).option("header", True).option("enforceSchema", False).csv(source))
    if months is not None:
        have = {r["month"] for r in rows.select("month").distinct().collect()}
        missing = sorted(set(months) - have)
        if missing:
            raise FileNotFoundError(f"no CSV rows for months {missing}")
        rows = rows.filter(F.col("month").isin(list(months)))
    if skip:
        rows = rows.filter(~F.col("month").isin(list(skip)))
    side = target.rstrip("/") + "_unchecked"
    (
        rows.repartitionByRange(*[F.col(c) for c in PARTITIONS], F.coalesce("origin_time", "received_time"), F.col("sequence_number"))
        .sortWithinPartitions(*PARTITIONS, "origin_time", "received_time", "sequence_number")
        .write.mode("overwrite")
        .partitionBy(*PARTITIONS)
        .parquet(side)
    )
    written = spark.read.parquet(side)
    records = compare_tables(rows, written, list(PARTITIONS))
    if records.filter(F.col("status") != "converted").limit(1).count():
        return records
    written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(target)
    return records


def row_digest(df: DataFrame, digits: int = 5):
    """An order-free sum of row hashes with floating columns rounded: equal for equal multisets of rows."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f.name)
        cells.append(F.round(c.cast("double"), digits) if f.dataType.typeName() in ("float", "double") else c.cast("string"))
    return F.sum(F.xxhash64(*cells).cast("decimal(20,0)"))


def compare_tables(a: DataFrame, b: DataFrame, by: list[str], also: tuple[Column, ...] = ()) -> DataFrame:
    """Row counts and whole-table digests of two tables per group; both tables are read once, nothing is joined row by row.

    ``also`` are further aggregates of ``a``, taken in the same pass.  Columns that ``b`` does not have are not compared.
    """
    cols = [c for c in a.columns if c in b.columns]
    left = a.groupBy(*by).agg(F.count("*").alias("n_source"), row_digest(a.select(*cols)).alias("d_source"), *also)
    right = b.select(*cols).groupBy(*by).agg(F.count("*").alias("n_written"), row_digest(b.select(*cols)).alias("d_written"))
    same = (F.col("n_source") == F.col("n_written")) & (F.col("d_source") == F.col("d_written"))
    return left.join(right, by, "full").select(
        *by, F.coalesce("n_source", F.lit(0)).alias("n_source"), F.coalesce("n_written", F.lit(0)).alias("n_written"),
        F.when(F.coalesce(same, F.lit(False)), "converted").otherwise("failed").alias("status"),
        *[c for c in left.columns if c not in (*by, "n_source", "d_source")],
    )


def conversion_summary(records: DataFrame) -> DataFrame:
    """Counts by outcome and a PASS / FAIL decision."""
    out = records.agg(
        F.count_if(F.col("status") == "converted").alias("n_converted"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "skipped").alias("n_skipped"),
        F.sum("n_source").alias("n_rows"),
        *[F.sum("n_bytes").alias("n_bytes")] * ("n_bytes" in records.columns),
    )
    ok = (F.col("n_failed") == 0) & (F.col("n_converted") + F.col("n_skipped") > 0)
    return out.withColumn("decision", F.when(ok, "PASS").otherwise("FAIL"))


def write_missing(df: DataFrame, path: str, partition: str) -> int:
    """Writes only the partitions ``path`` does not hold yet and returns how many there were."""
    spark = df.sparkSession
    todo = df.select(partition).distinct()
    try:
        done = spark.read.parquet(path).select(F.col(partition).cast(df.schema[partition].dataType)).distinct()
        todo = todo.join(done, partition, "left_anti")
    except Exception as e:  # the folder does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = todo.count()
    if n:
        df.join(todo, partition, "left_semi").write.mode("append").partitionBy(partition).parquet(path)
    return n
