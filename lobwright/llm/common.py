"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lobwright.sources.stages import cut

#: Tables that hold at most so many rows (counted, not guessed) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: White space of the word rules: space and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column that is used inside a lambda is otherwise evaluated again for each element, because the optimizer merges
    projections.
    """
    return F.transform(F.array(value), body)[0]


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, name: str = "bounded") -> DataFrame:
    """``df`` written once and counted: with the broadcast hint if it has at most ``rows`` rows, else without."""
    kept = cut(df, name)
    return F.broadcast(kept) if kept.count() <= rows else kept


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the text's runs of letters and digits, lower-cased: punctuation, case and line breaks don't count."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(found, lambda w: F.xxhash64(w))


def row_key() -> Column:
    """A key of a document by id and text.  Rows that share it are equal, or are told apart by the check that follows."""
    return F.xxhash64("doc_id", "text")
