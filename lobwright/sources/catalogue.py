"""Catalogue of monthly snapshot files, and planning of time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Month tokens and the file-name pattern.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
FILE_PATTERN = r"BOOK_([A-Z0-9]+)_([A-Z0-9\-]+)_([A-Z]{3})-(\d{4})\.parquet$"
DAY_US = 86_400_000_000


def parse_names(files: DataFrame, name: str = "file_name") -> DataFrame:
    """exchange, symbol, month, year and period (``2024-01``) of each file name; other names are left out.

    A name whose month token is unknown keeps a NULL period.
    """
    part = {c: f"regexp_extract({name}, '{FILE_PATTERN}', {i})".replace("\\", "\\\\")
            for i, c in ((1, "exchange"), (2, "symbol"), (3, "month"), (4, "year"))}
    out = files.filter(F.col(name).rlike(FILE_PATTERN)).selectExpr("*", *[f"{v} as {k}" for k, v in part.items()])
    number = "array_position(array(" + ", ".join(f"'{m}'" for m in MONTHS) + "), month)"
    return out.selectExpr(
        *files.columns, "exchange", "symbol", "month", "bigint(year) as year",
        f"if({number} > 0, concat(year, '-', lpad(string({number}), 2, '0')), null) as period",
    )


def file_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Every snapshot file under ``root`` with its size; file contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "BOOK_*_*.parquet")
        .load(root)
        .selectExpr("path as file_path", "element_at(split(path, '/'), -1) as file_name", "length as file_bytes")
    )
    return parse_names(files).withColumn("file_size_mb", F.round(F.col("file_bytes") / (1024.0 * 1024.0), 4))


def filter_catalogue(catalogue: DataFrame, exchange: str | None = None, symbol: str | None = None) -> DataFrame:
    out = catalogue
    if exchange:
        out = out.filter(F.col("exchange") == exchange)
    if symbol:
        out = out.filter(F.col("symbol") == symbol)
    return out


def overlapping(catalogue: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Files whose month meets [start, end]; a file of unknown period is kept."""
    first = F.to_timestamp(F.concat("period", F.lit("-01")))
    after = F.add_months(first, 1).cast("timestamp")
    keep = F.lit(True)
    if start is not None:
        keep = keep & (after > F.lit(start).cast("timestamp"))
    if end is not None:
        keep = keep & (first <= F.lit(end).cast("timestamp"))
    return catalogue.filter(F.col("period").isNull() | keep)


def day_windows(df: DataFrame, days: int, time_col: str = "event_us") -> DataFrame:
    """Half-open windows of ``days`` days over the span of the data, per symbol, with their row counts.

    The plan comes from the minimum and maximum; rows are counted where they fall, no range join is needed.
    """
    if days <= 0:
        raise ValueError("days must be positive")
    width = days * DAY_US
    span = df.groupBy("symbol").agg(
        F.expr(f"min({time_col}) div {DAY_US} * {DAY_US} as lo"), F.expr(f"max({time_col}) as hi")
    )
    plan = span.selectExpr("symbol", "lo", "hi", f"explode(sequence(0L, (hi - lo) div {width})) as i").selectExpr(
        "symbol", "i", f"lo + i * {width} as start_us", f"lo + (i + 1) * {width} as end_us"
    )
    counted = (
        df.join(span.select("symbol", "lo"), "symbol")
        .groupBy("symbol", F.expr(f"({time_col} - lo) div {width} as i"))
        .agg(F.count("*").alias("n_rows"))
    )
    token = (
        "concat('D', lpad(string(i + 1), 3, '0'), '_', date_format(timestamp_micros(start_us), 'yyyyMMdd'), '_', "
        "date_format(timestamp_micros(end_us - 1), 'yyyyMMdd'))"
    )
    return plan.join(counted, ["symbol", "i"], "left").selectExpr(
        "symbol", f"{token} as token", "start_us", "end_us", "coalesce(n_rows, 0L) as n_rows"
    )


def month_windows(tokens: list[str], start: str, end: str) -> list[tuple[str, str, str]]:
    """(token, start, end) of named months of the start year, clipped to the range, half-open."""
    year, out = int(start[:4]), []
    for token in tokens:
        m = MONTHS.index(token.upper()) + 1
        lo = f"{year:04d}-{m:02d}-01"
        hi = f"{year + m // 12:04d}-{m % 12 + 1:02d}-01"
        out.append((token.upper(), max(lo, start), min(hi, end)))
    return sorted(out, key=lambda w: w[1])
