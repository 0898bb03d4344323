"""Near-duplicates by SimHash.

A text's fingerprint has 64 bits: bit k is set if over half of the hashes of its word shingles have it set.  Two texts are
linked if their fingerprints differ in at most ``BITS`` places; groups are the connected components of the links.

Pigeonhole blocks find the links: fingerprints are cut into four blocks, and two that differ in two places agree on two
whole blocks, so they meet in an equi-join on one of the six pairs of blocks (32 bits); the Hamming distance is then
verified.  Work is done on distinct fingerprints, so copies cost nothing.  Where more than ``BUCKET`` distinct fingerprints
agree on two blocks, not all their pairs are compared: each names itself and its one-bit neighbours in the other 32 bits, and
those that name the same neighbour are linked in a star.  Two fingerprints are within two bits of each other exactly if they
name a common neighbour, so no link is lost and a bucket costs 33 rows per member, whatever its size.

Null and blank texts have the fingerprint zero and are linked like any other; fewer words than a shingle give one shingle of
all; repeated shingles count; repeated rows get the same answer each; an empty table gives no rows.  Only the id and the
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lobwright.llm.common import bounded
from lobwright.llm.components import components
from lobwright.sources.stages import cut

SEED = 42
SHINGLE = 3
BITS = 2
BLOCKS = 4
BUCKET = 100

#: Hashes whose bits are counted together.
SLICE = 1 << 14


def _fingerprint(text: bytes | None, shingle: int) -> int:
    found = text.lower().split() if text else []
    if not found:
        return 0
    parts = map(b" ".join, zip(*[found[k:] for k in range(shingle)])) if len(found) > shingle else [b" ".join(found)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SLICE):
        counts += np.unpackbits(hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint) of each of ``docs`` (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([_fingerprint(t, shingle) for t in texts], pa.int64())], names=["id", "fingerprint"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fingerprint long")


def links(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) of distinct fingerprints at most ``bits`` = 2 apart: all such pairs, but stars inside crowded buckets."""
    width = 64 // BLOCKS
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [signed(sum(((1 << width) - 1) << (width * b) for b in c)) for c in combinations(range(BLOCKS), BLOCKS - bits)]
    keyed = classes.select("fingerprint", F.explode(F.array(*[
        F.struct(F.lit(m).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("block")) for m in masks])).alias("k")
    ).select("k.mask", "k.block", "fingerprint")
    crowds = bounded(keyed.groupBy("mask", "block").agg(F.count("*").alias("n")).where("n > 1"), name="blocks")
    met = cut(keyed.join(crowds, ["mask", "block"]), "block_members")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    few = met.where(F.col("n") <= BUCKET)
    pairs = few.withColumnRenamed("fingerprint", "a").join(
        few.select("mask", "block", F.col("fingerprint").alias("b")), ["mask", "block"]).where("a < b").where(near).select("a", "b")
    names = [F.col("fingerprint")] + [
        F.when(F.lit(signed(1 << k)).bitwiseAND(F.col("mask")) == 0, F.col("fingerprint").bitwiseXOR(F.lit(signed(1 << k)))) for k in range(64)]
    many = met.where(F.col("n") > BUCKET).select("mask", "fingerprint", F.explode(F.array_compact(F.array(*names))).alias("named"))
    hub = F.min("fingerprint").over(Window.partitionBy("mask", "named"))  # 65 members at most
    stars = many.select(hub.alias("a"), F.col("fingerprint").alias("b")).where("a <> b").where(near)
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(id, fingerprint, component_id) of each of ``docs`` (id, text): the smallest id of its group.

    The texts are read once; everything after works on 16-byte rows.  A fingerprint shared by a third of all documents is
    one row of ``classes`` after a partial aggregation, and a splittable side of the last join.
    """
    prints = cut(fingerprints(docs, shingle), "fingerprints")
    classes = cut(prints.groupBy("fingerprint").agg(F.min("id").alias("first")), "classes")
    groups = cut(components(links(classes, bits)), "groups")
    roots = groups.join(classes, groups.node == classes.fingerprint).groupBy("root").agg(F.min("first").alias("least"))
    named = groups.join(roots, "root").select(F.col("node").alias("fingerprint"), "least")
    named = classes.join(bounded(named, name="named_groups"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("least", "first").alias("component_id"))
    return prints.join(named, "fingerprint").select("id", "fingerprint", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of ``docs`` (doc_id, text), the fingerprint in 16 hex digits."""
    found = near_duplicates(docs.select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns: of each group the one with the smallest ``doc_id``, of equal ids the first row.

    Rows are told apart by their place in a written copy, so null and repeated ids are rows like others.
    """
    boxed = cut(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "dedup_rows")
    rows = boxed.select(F.struct(F.col("doc.doc_id").alias("doc_id"), F.col("row")).alias("id"), F.col("doc.text").alias("text"))
    kept = near_duplicates(rows).where("id = component_id").select(F.col("id.row").alias("row"))
    return boxed.join(kept, "row", "left_semi").select("doc.*")
