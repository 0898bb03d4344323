"""What a fitted number has read: one bit per split, carried from the rows through fits, grids and winners.

A row knows the symbol it comes from (``_from``), also where it is used under another key, and the bit of its split.  A fit's
reads are the bits of its rows OR-ed per key and origin, and whatever is derived from several fits has read what they have.
Whether a protocol was kept is then computed, not claimed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the splits; rows of no known split have one of their own.
BITS = {"train": 1, "valid": 2, "test": 4}
UNKNOWN = 8


def with_origin(df: DataFrame) -> DataFrame:
    """Rows with the symbol they come from and the bit of their split; an origin that is there stays."""
    bit = F.lit(UNKNOWN)
    for name, value in BITS.items():
        bit = F.when(F.col("split") == name, value).otherwise(bit)
    return df if "_from" in df.columns else df.withColumns({"_from": F.col("symbol"), "_bit": bit})


def reads(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, ``_from``, ``bits``): what fits over ``frames`` read under each key."""
    narrow = [with_origin(f).select(*keys, "_from", "_bit") for f in frames]
    return reduce(DataFrame.union, narrow).groupBy(*keys, "_from").agg(F.bit_or("_bit").alias("bits"))


def own_reads(frames: list[DataFrame], keys: list[str], name: str) -> DataFrame:
    """(keys, ``name``): all bits read under a key; rows that come from another symbol count as unknown."""
    bit = F.when(F.col("_from") == F.col("symbol"), F.col("bits")).otherwise(F.lit(UNKNOWN))
    return reads(frames, keys).groupBy(*keys).agg(F.bit_or(bit).alias(name))


def split_names(bits: Column) -> Column:
    """The splits in ``bits``, comma-joined."""
    names = {**BITS, "unknown": UNKNOWN}
    return F.array_join(F.filter(F.array(*[F.when(bits.bitwiseAND(F.lit(b)) != 0, n) for n, b in names.items()]), lambda x: x.isNotNull()), ",")


def selection_status(bits: Column) -> Column:
    """Whether a selection kept away from test rows and from rows of unknown origin."""
    return F.when(bits.bitwiseAND(F.lit(BITS["test"] | UNKNOWN)) != 0, "FAIL_TEST_SELECTION").otherwise("PASS_VALIDATION_ONLY")


def transfer_protocol(read: DataFrame, directions: DataFrame) -> DataFrame:
    """``directions`` (train_symbol, test_symbol) with what was read of the source, the target and others, and PASS or FAIL.

    ``read`` is (train_symbol, test_symbol, ``_from``, ``bits``).  A transfer may read the source's train and validation rows.
    """
    part = lambda test: F.coalesce(F.bit_or(F.when(test, F.col("bits"))), F.lit(0))
    source, target = F.col("_from") == F.col("train_symbol"), F.col("_from") == F.col("test_symbol")
    found = read.groupBy("train_symbol", "test_symbol").agg(
        part(source).alias("source_reads"), part(target).alias("target_reads"), part(~source & ~target).alias("other_reads"))
    clean = (F.col("source_reads").bitwiseAND(F.lit(BITS["test"] | UNKNOWN)) == 0) & (F.col("target_reads") == 0) & (F.col("other_reads") == 0)
    return directions.join(found, ["train_symbol", "test_symbol"]).withColumn("status", F.when(clean, "PASS").otherwise("FAIL"))
