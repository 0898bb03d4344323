"""The CSV conversion job: months of CSV files to sorted, partitioned parquet, with a record for each month.

A month is published as a whole or not at all.  Its rows are written to a hidden folder beside the target, counted and compared
with the source, and only then renamed into place by the target's own file system, so nothing is written twice and no reader
sees half a month.  Records are appended to a manifest in the target; a month is skipped if the manifest, the number of stored
rows and the sizes of its source files still agree.  A month that fails leaves what was published before as it was.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobwright.sources.scan import read_many
from lobwright.sources.sink import PARTITIONS, compare_tables, csv_schema, typed
from lobwright.sources.stages import cut

#: Where in a file's path its month stands: between a separator and a separator.
MONTH_IN_PATH = r"[/_=](\d{4}-\d{2})[/._]"

MANIFEST = "_conversions"
RECORD = "month string, status string, reason string, n_source long, n_written long, n_files long, n_bytes long, run_us long"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def input_files(spark: SparkSession, source: str, months=None, pattern: str = MONTH_IN_PATH) -> dict[str, list[tuple[str, int]]]:
    """(path, bytes) of the CSV files under ``source`` by month.  A requested month without a file is an error."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(source)
    found: dict[str, list[tuple[str, int]]] = {}
    for path, size in sorted(listed.select("path", "length").collect()):
        month = re.search(pattern, path)
        if month is not None:
            found.setdefault(month[1], []).append((path, size))
    if months is not None:
        missing = sorted(set(months) - set(found))
        if missing:
            raise FileNotFoundError(f"no CSV file for months {missing}")
        found = {m: found[m] for m in sorted(set(months))}
    return found


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The names in a file's first line; only its first block is read."""
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return (spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or "").split(",")
    finally:
        stream.close()


def csv_rows(spark: SparkSession, paths: list[str], levels: int = 20, pattern: str = MONTH_IN_PATH) -> DataFrame:
    """Typed rows, the month of their file, and ``_bad``: cells that don't parse, cells missing or left over, an unreadable time."""
    schema = T.StructType([*csv_schema(levels).fields, T.StructField("_line", T.StringType())])
    raw = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "_line").csv(paths)
    text = F.coalesce(F.length(F.trim("origin_time")), F.lit(0)), F.coalesce(F.length(F.trim("received_time")), F.lit(0))
    kept = raw.select("*", F.regexp_extract("_metadata.file_path", pattern, 1).alias("_month"), (text[0] > 0).alias("_o"), (text[1] > 0).alias("_r"))
    rows = typed(kept).withColumn("month", F.col("_month"))
    unread = (F.col("_o") & F.col("origin_time").isNull()) | (F.col("_r") & F.col("received_time").isNull())
    return rows.withColumn("_bad", F.col("_line").isNotNull() | unread).drop("_line", "_month", "_o", "_r")


def _unchanged(spark: SparkSession, target: str, files: dict[str, list[tuple[str, int]]]) -> dict[str, int]:
    """Months, with their rows, whose last record, stored rows and source files agree."""
    fs, manifest = _fs(spark, f"{target}/{MANIFEST}")
    if not fs.exists(manifest):
        return {}
    last = spark.read.schema(RECORD).parquet(f"{target}/{MANIFEST}").filter("status = 'converted'").groupBy("month").agg(
        F.max_by(F.struct("n_written", "n_files", "n_bytes"), "run_us").alias("was"))
    schema = T.StructType([T.StructField(p, T.StringType()) for p in PARTITIONS])
    stored = read_many(spark, target, schema).groupBy("month").agg(F.count("*").alias("n"))
    same = last.join(stored, "month").filter("was.n_written = n").select("month", "n", "was.n_files", "was.n_bytes").collect()
    return {m: n for m, n, count, size in same if m in files and (count, size) == (len(files[m]), sum(s for _, s in files[m]))}


def _publish(spark: SparkSession, staged: str, target: str, month: str, aside: str) -> None:
    """Renames a staged month into the target; what the target had of it goes first, and comes back if a rename fails."""
    fs, _ = _fs(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    places = "/".join(f"{p}={month if p == 'month' else '*'}" for p in PARTITIONS)
    moved = []

    def move(origin, folder: str) -> None:
        to = path(folder + "/" + "/".join(str(origin).split("/")[-len(PARTITIONS):]))
        fs.mkdirs(to.getParent())
        if not fs.rename(origin, to):
            raise OSError(f"cannot rename {origin} to {to}")
        moved.append((origin, to))

    try:
        for found in fs.globStatus(path(f"{target}/{places}")) or []:
            move(found.getPath(), aside)
        for found in fs.globStatus(path(f"{staged}/{places}")) or []:
            move(found.getPath(), target)
    except Exception:
        for origin, to in reversed(moved):
            fs.rename(to, origin)
        raise


def convert_months(
    spark: SparkSession, source: str, target: str, months=None, levels: int = 20, pattern: str = MONTH_IN_PATH, again: bool = False
) -> DataFrame:
    """Converts the months of ``source`` that ``target`` does not hold yet (``again``: all) and returns one record per month.

    ``status`` is ``converted``, ``skipped`` or ``failed``, the last with a reason: another header, lines that can't be read, or a
    copy that differs from its source.  Only names, sizes and counts, a few per month, come to the driver.
    """
    target = target.rstrip("/")
    files = input_files(spark, source, months, pattern)
    size = {m: (len(f), sum(s for _, s in f)) for m, f in files.items()}
    now = int(spark.sql("select unix_micros(current_timestamp())").first()[0])
    done = {} if again else _unchanged(spark, target, files)
    want = csv_schema(levels).names
    known = [(m, "skipped", "", n, n, *size[m], now) for m, n in done.items()]
    odd = [m for m, f in files.items() if m not in done and any(header_of(spark, p) != want for p, _ in f)]
    known += [(m, "failed", "header", 0, 0, *size[m], now) for m in odd]
    todo = [p for m, f in files.items() if m not in done and m not in odd for p, _ in f]
    side = f"{target}/_staging-{os.urandom(4).hex()}"
    try:
        if todo:
            rows = csv_rows(spark, todo, levels, pattern)
            good = rows.drop("_bad")
            time = F.coalesce("origin_time", "received_time")
            good.repartitionByRange(*PARTITIONS, time, F.col("sequence_number")).sortWithinPartitions(*PARTITIONS, time, "sequence_number").write.partitionBy(
                *PARTITIONS).parquet(f"{side}/new")
            # In the pass that reads every cell: the file source parses, and finds faulty, only the columns that are asked for.
            n_bad = F.count_if("_bad").alias("n_bad")
            compared = compare_tables(rows, spark.read.schema(good.schema).parquet(f"{side}/new"), ["month"], (n_bad,))
            seen = {r["month"]: r for r in compared.collect()}
            for m in sorted({m for m in files if m not in done and m not in odd}):
                r = seen.get(m)
                wrong = "empty" if r is None else "unreadable lines" if r["n_bad"] else "" if r["status"] == "converted" else "copy differs"
                if not wrong:
                    _publish(spark, f"{side}/new", target, m, f"{side}/old")
                counts = (0, 0) if r is None else (r["n_source"], 0 if wrong else r["n_written"])
                known.append((m, "failed" if wrong else "converted", wrong, *counts, *size[m], now))
    finally:
        fs, where = _fs(spark, side)
        fs.delete(where, True)
    records = cut(spark.createDataFrame(sorted(known), RECORD), "conversion_records")
    records.write.mode("append").parquet(f"{target}/{MANIFEST}")
    return records
