"""A uniform shuffle of a table into shards of exact size.

A sequential shuffle would draw one permutation of all rows.  The same distribution comes from four local steps: draw how
many rows each source partition sends to each shard (a matrix with given row and column sums, hypergeometric draw by
draw), permute each partition and cut it by its row of the matrix, exchange, and permute each shard.

Law ``rows``: shard sizes differ by one row at most.  Null ids and texts are rows like others (a null text has no bytes and
the checksum of the empty text); repeated rows are separate rows; an empty table gives no row; further columns are not
read.  The row's identity is its place in a written copy of the narrow columns, so a recomputed task deals the same cards.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobwright.llm.common import bounded
from lobwright.sources.stages import cut

#: Source partitions beyond this number are taken together, so that the matrix stays small at any size of the table.
MAX_SOURCES = 2048

#: Blocks into which the second permutation of a shard is split, so that no task holds a whole shard.
ROWS_PER_BLOCK = 500_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` cards, drawn from ``good + bad`` without putting back, are good.

    Inversion from the mode outwards: the expected number of steps is the standard deviation, not the range.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    ways = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    top = math.exp(ways(good, mode) + ways(bad, draws - mode) - ways(good + bad, draws))
    u = rng.random() - top
    down, up, p_down, p_up = mode, mode, top, top
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(sources: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows sum to ``sources``, columns to ``shards``; distributed as in a uniform permutation of all rows."""
    rng, left, matrix = random.Random(seed), list(shards), []
    for size in sources:
        row, room, rest = [], sum(left), size
        for k, open_ in enumerate(left):
            sent = hypergeometric(rng, open_, room - open_, rest)
            room -= open_
            rest -= sent
            left[k] -= sent
            row.append(sent)
        matrix.append(row)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """The rows of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Both permutations are row numbers over hashed order inside groups of bounded size: a source partition, and a block of
    a shard.  Only counts come to the driver: one per source (at most ``MAX_SOURCES``) and one per block.
    """
    spark, columns = df.sparkSession, df.columns
    boxed = cut(df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "shard_rows")
    source = (F.shiftrightunsigned("row", 33) % MAX_SOURCES).cast("int")
    counts = sorted(tuple(r) for r in boxed.groupBy(source.alias("source")).count().collect())
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], shard_sizes(total, shards), seed)
    ends = []
    for (k, _), row in zip(counts, matrix, strict=True):
        end, cumulated = 0, []
        for n in row:
            end += n
            cumulated.append(end)
        ends.append((k, cumulated))
    matrix_df = F.broadcast(spark.createDataFrame(ends, "source int, ends array<long>"))  # MAX_SOURCES rows at most
    dealt = boxed.select("doc", "row", source.alias("source")).withColumn(
        "place", F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "row"), "row")))
    blocks = max(1, math.ceil(total / shards / ROWS_PER_BLOCK))
    sent = cut(dealt.join(matrix_df, "source").select(
        "doc", "row", F.size(F.filter("ends", lambda e: e < F.col("place"))).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "row"), F.lit(blocks)).cast("int").alias("block")), "sharded")
    sizes = sent.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = bounded(sizes.select("shard", "block", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before")), name="shard_blocks")
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy(F.xxhash64(F.lit(seed + 2), "row"), "row"))
    return sent.withColumn("inside", inside).join(before, ["shard", "block"]).select(
        "doc.*" if columns else F.lit(None), F.col("shard"), (F.col("before") + F.col("inside") - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of ``docs`` (doc_id, text).

    The size is the text's UTF-8 bytes plus 16.  Only the narrow columns travel.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(narrow, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
