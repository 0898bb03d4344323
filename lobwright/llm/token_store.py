"""Token ids in ORC files.

Rows are range-partitioned and sorted by document id, so that every stripe covers a narrow range of ids; integers are
run-length encoded by the format; row-group indexes and Bloom filters on ``doc_id`` let a lookup skip stripes and row
groups; a reader gets stripes as separate splits.  The file's own columns say which partition wrote a row and how many ids
lie before it there, so global positions follow from one count per partition.

Null text counts as empty; each document ends with the end id, so an empty one has that id alone.  Rows with a null id sort
first; rows with equal ids are ordered by text, equal rows are interchangeable.  An empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lobwright.llm.common import bounded
from lobwright.llm.tokens import encoder

#: Documents encoded together inside an Arrow batch.
SLICE = 512

#: Format settings: small stripes and row groups, since a row is a whole document.
ORC_OPTIONS = {
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "compression": "zstd",
}

STORED = "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>"


def _encode(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before, end = encoder(vocabulary).encode, 0, np.uint32(end_id).astype("<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids = [x + end for x in encode(batch.column("text").to_pylist())]
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part"), batch.column("doc_id"), pa.array(before + ends - sizes), pa.array(sizes), lists],
                    names=["part", "doc_id", "start_in_part", "n_tokens", "ids"])
                before += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the ids as ORC, in ascending order of ``doc_id``.

    One shuffle of the texts.  The order of a partition is total up to equal rows, so a task that runs again writes the
    same file.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    stored = placed.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_encode(vocabulary, end_id), STORED)
    stored.write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` is the number of ids of all documents before."""
    stored = spark.read.schema(STORED).orc(path)
    # One row for each written partition.
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = bounded(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")), name="token_parts")
    return stored.join(before, "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The stored rows of some documents; the predicate reaches the format's statistics and Bloom filters."""
    return spark.read.schema(STORED).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ends, raw = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each stored document, computed from the files."""
    return read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
