"""One document of each group of near copies: word shingles of five, Jaccard similarity of at least 0.8.

The similarity is that of the sets of shingles (lower-cased ASCII, words between white space), and every link is verified on
the texts.  Candidates come from SimHash by the pigeonhole principle.  One fingerprint of a whole text does not separate here: at
0.8 one bit in seven differs, so that no block long enough to part unrelated texts stays whole.  So the blocks are made before
the bits: shingles are dealt by hash into parts of three to six, and each part has its own 64-bit SimHash (bit k is set if over half of
its hashes have it set).  Two texts that differ in few shingles have parts where they differ in none, and meet on the fingerprint of
such a part.  Of ``KEYS`` parts a pair at exactly 0.8 shares one with probability 0.9996 or more; the number of parts follows
from the size, and texts within a quarter above a step of it are dealt both ways, so that such pairs always have parts in common.

Within a bucket every member is first verified against one hub; groups are the components of what holds.  Members that are then
in another group than most of their bucket are verified against ``PIVOTS`` members of that group, ``REPEATS`` times over.  What is
left is not compared pair by pair.  Two sets of ``n`` and ``m`` shingles are similar exactly if at most a ninth of ``n + m`` are in one of
them alone.  Shingles that at most ``RARE`` of the texts in question hold are the text's own: texts that share none of those differ
in all of them, and in their other shingles at least by the difference of the numbers.  So a pair is verified only if these numbers
allow it (compared by classes of equal numbers, not by texts), or if it shares one of its rarest (a join of at most ``RARE`` rows for
each; a text's rarest quarter and one are enough, since a similar text lacks no more than a quarter).  Both are bounds, so no link of a bucket goes unseen; around a large group they leave the few pairs that are near the limit.
Many texts of one bucket that differ by nothing but frequent shingles would still be compared pair by pair.

Null and blank texts are copies of each other; fewer words than a shingle give one shingle of all.  Exact copies (after the same
normalization, by a 128-bit digest) are one class before anything is compared.  Repeated rows and equal or null ids are rows of
their own, told apart by their place; an empty table gives an empty table; other columns stay, whatever their names.  Very long
texts are compared in whole, by the hashes of all their shingles.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lobwright.llm.common import bounded
from lobwright.llm.components import components
from lobwright.sources.stages import cut

#: Fixed values.
SHINGLE = 5
LEAST = 0.8
SEED = 42

#: Fingerprinted parts of a text; of these so many at most by one way of dealing.
KEYS = 32
PARTS = 16

#: Shingles of a part on average: at least so many, and less than twice that.
MEAN = 3

#: Members of the main group of a bucket that those outside it are compared with, and how often.
PIVOTS = 4
REPEATS = 2

#: A shingle in at most so many of the texts that are left is rare.
RARE = 64

#: Shingles that are dealt together.
SLICE = 1 << 12

#: Pairs of one text that a task verifies; the pairs of a hub with more are dealt over several tasks.
DEALT = 500

_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 63, (KEYS // 2, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, (KEYS // 2, 1), dtype=np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    found = text.lower().split() if text else []
    parts = map(b" ".join, zip(*[found[k:] for k in range(SHINGLE)])) if len(found) > SHINGLE else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64))


def part_prints(hashes: np.ndarray, log: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts, fingerprints) of a set of shingles that is dealt into ``2 ** log`` parts, several ways; parts too small to tell texts apart are left out."""
    kept = min(1 << log, PARTS)
    ways = KEYS // kept
    found = []
    for at in range(0, len(hashes), SLICE):
        some = hashes[at : at + SLICE]
        dealt = (some * _TIMES[:ways] + _PLUS[:ways]) >> np.uint64(64 - log)
        way, place = np.nonzero(dealt < kept)
        found.append((way * kept + dealt[way, place].astype(np.int64), some[place]))
    part, of = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(part):
        return part, of
    order = np.argsort(part, kind="stable")
    part, starts, sizes = np.unique(part[order], return_index=True, return_counts=True)
    bits = np.unpackbits(of[order].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    prints = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    large = sizes >= min(log, MEAN)
    return part[large], prints[large]


def print_keys(hashes: np.ndarray) -> list[int]:
    """The keys of a set of shingles: equal for two sets where a part of both has the same fingerprint."""
    log = max(1, (len(hashes) // MEAN).bit_length() - 1)
    keys: list[int] = []
    for k in (log, log - 1) if log > 1 and 4 * len(hashes) < 5 * (MEAN << log) else (log,):
        parts, prints = part_prints(hashes, k)
        keys += [xxhash.xxh64_intdigest(p, k * KEYS + at) - (1 << 63) for at, p in zip(parts.tolist(), map(bytes, prints.view(np.uint8).reshape(-1, 8)), strict=True)]
    return keys


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signatures(docs: DataFrame) -> DataFrame:
    """(id, digest, n, keys) of each of ``docs`` (id, text); ``n`` counts the distinct shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, keys = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                hashes = shingles(text)
                digests.append(xxhash.xxh3_128_digest(b" ".join(text.lower().split()) if text else b"", SEED))
                sizes.append(len(hashes))
                keys.append(print_keys(hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "digest", "n", "keys"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, digest binary, n int, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of all ``pairs`` (a, b), their texts from ``texts`` (row, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(row: int, text: pa.Scalar) -> np.ndarray:
            if row not in known:
                known[row] = shingles(text.as_py())
                if len(known) > 64:
                    known.popitem(last=False)
            return known[row]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found = [jaccard(of(x, s), of(y, t)) for x, y, s, t in zip(a, b, batch.column("text_a"), batch.column("text_b"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    copies = parts.join(texts, F.col("a") == F.col("row")).select("a", F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sides = dealt.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b").join(copies, ["a", "part"])
    return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def links(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of the classes (row, n, keys) that are linked to others; ``rows`` (row, text) holds their texts."""
    keyed = classes.select("row", "n", F.explode("keys").alias("key"))
    shared = bounded(keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("row").alias("hub")).where("members > 1").select("key", "hub"), name="buckets")
    met = cut(keyed.join(shared, "key"), "bucket_members")
    texts = cut(rows.join(bounded(met.select("row").distinct(), name="met"), "row"), "met_texts")
    star = cut(verified(met.where("hub <> row").select(F.col("hub").alias("a"), F.col("row").alias("b")).distinct(), texts), "hub_pairs")
    away = F.when(F.col("row") == F.col("hub"), 0.0).otherwise(1 - F.col("similarity"))
    placed = cut(met.join(star.select(F.col("a").alias("hub"), F.col("b").alias("row"), "similarity"), ["hub", "row"], "left").select(
        "key", "row", "n", away.alias("away")), "distances")
    tried = star
    sized = lambda x, y: 10 * F.least(x, y) >= 8 * F.greatest(x, y)  # noqa: E731  else the sizes alone forbid it
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    for k in range(REPEATS + 1):
        groups = cut(components(tried.where(F.col("similarity") >= LEAST).select("a", "b")), "link_groups")
        if k == REPEATS:
            break
        outside, inside = _apart(placed, groups)
        seeds = range(k * PIVOTS, (k + 1) * PIVOTS)
        pivots = inside.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("row", F.lit(i)), "row", "n")).alias(f"p{i}") for i in seeds]).select(
            "key", F.explode(F.array_distinct(F.array(*[F.struct(f"p{i}.row", f"p{i}.n") for i in seeds]))).alias("pivot"))
        new = outside.join(pivots, "key").where(sized(F.col("n"), F.col("pivot.n"))).select(*ordered(F.col("row"), F.col("pivot.row"))).distinct()
        new = cut(new.join(tried, ["a", "b"], "left_anti"), "pivot_pairs")
        if new.isEmpty():
            break
        tried = cut(tried.union(verified(new, texts)), "tried_pairs")
    outside, inside = _apart(placed, groups)
    rest = _possible(outside, inside, texts)
    rest = cut(rest.join(tried, ["a", "b"], "left_anti"), "other_pairs")
    if rest.isEmpty():
        return groups
    return components(cut(tried.union(verified(rest, texts)).where(F.col("similarity") >= LEAST).select("a", "b"), "links"))


def held_shingles(rows: DataFrame) -> DataFrame:
    """(row, shingle) of all distinct shingles of ``rows`` (row, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                found = shingles(text.as_py()).view(np.int64)
                for at in range(0, len(found), SLICE):
                    some = pa.array(found[at : at + SLICE])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row)), some], names=["row", "shingle"])

    return rows.select("row", "text").mapInArrow(run, "row long, shingle long")


def rare_shingles(held: DataFrame) -> DataFrame:
    """(row, shingle, holders) of the shingles that at most ``RARE`` of the rows hold.

    One shuffle of the shingles at any size.  A count that is joined back is broadcast while it is small and a second shuffle later.
    """
    return held.select("row", "shingle", F.count("*").over(Window.partitionBy("shingle")).alias("holders")).where(F.col("holders") <= RARE)


def _first_shingles(shared: DataFrame, known: DataFrame) -> DataFrame:
    """The rare shingles by which a text can meet another: the rarest first, its own alone before all, a quarter of its size and one.

    A similar text lacks at most a quarter of a text's shingles, so two that are similar through rare ones have one of these in common.
    """
    place = F.col("alone") + F.row_number().over(Window.partitionBy("row").orderBy("holders", "shingle"))
    return shared.join(known, "row").withColumn("place", place).where("4 * (place - 1) <= n").select("shingle", "row", "n", "root", "out", "own")


def _possible(outside: DataFrame, inside: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs of a bucket, one outside its main group, that the numbers of rare and other shingles allow."""
    out = cut(outside.withColumn("out", F.lit(True)).union(inside.withColumn("out", F.lit(False))), "open_members")
    rows = out.groupBy("row", "n", "root").agg(F.max("out").alias("out"))
    rare = cut(rare_shingles(held_shingles(texts.join(rows.select("row"), "row", "left_semi"))), "rare_shingles")
    shared = rare.where("holders > 1")
    own = rare.groupBy("row").agg(F.count("*").alias("own"), F.sum((F.col("holders") == 1).cast("long")).alias("alone"))
    known = cut(rows.join(own, "row", "left").select("row", "n", "root", "out", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("own", "alone")]), "profiles")
    size = lambda t: F.col(f"{t}.n") - F.col(f"{t}.own")  # noqa: E731  shingles that are not rare
    # 9 times the least number of shingles in one of two sets alone, if they share no rare one, less what LEAST allows.
    excess = 9 * (F.col("x.own") + F.col("y.own") + F.abs(size("x") - size("y"))) - F.col("x.n") - F.col("y.n")
    ordered = [F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")]

    members = cut(out.join(known.select("row", "own"), "row"), "profiled_members")
    classes = members.groupBy("key", "n", "own").agg(F.max("out").alias("out"))
    like = classes.where("out").alias("x").join(classes.alias("y"), F.col("x.key") == F.col("y.key")).where(excess <= 0).select(
        F.col("x.key").alias("key"), F.col("x.n").alias("n"), F.col("x.own").alias("own"), F.col("y.n").alias("n_y"), F.col("y.own").alias("own_y"))
    asked = members.where("out").join(like, ["key", "n", "own"]).alias("x")
    near = F.abs(F.col("x.away") - F.col("y.away")) <= 1 - LEAST + 1e-9
    alike = asked.join(members.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.n_y") == F.col("y.n")) & (F.col("x.own_y") == F.col("y.own"))).where(
        "x.root <> y.root and (not y.out or x.row < y.row)").where(near).select(*ordered)

    first = cut(_first_shingles(shared, known), "first_shingles")
    able = 9 * (F.abs(F.col("x.own") - F.col("y.own")) + F.abs(size("x") - size("y"))) <= F.col("x.n") + F.col("y.n")  # if all rare ones of the lesser are shared
    sharing = first.where("out").alias("x").join(first.alias("y"), F.col("x.shingle") == F.col("y.shingle")).where(
        "x.root <> y.root and (not y.out or x.row < y.row)").where(able).select(*ordered)
    return alike.union(sharing).distinct()


def _apart(placed: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (key, row, n, away, root) outside and inside the largest group of their bucket, of buckets with several."""
    rooted = placed.join(groups.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("size"))
    split = sizes.groupBy("key").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count("*").alias("groups")).where("groups > 1").select("key", "main")
    open_ = cut(rooted.join(split, "key"), "split_members")
    return open_.where("root <> main").drop("main"), open_.where("root = main").drop("main")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns: of each group the one with the smallest ``doc_id``, of equal ids the first row.

    Rows are told apart by their place in a written copy, so null and repeated ids are rows like others.
    """
    boxed = cut(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "dedup_rows")
    signed = cut(signatures(boxed.select(F.struct(F.col("doc.doc_id").alias("doc_id"), F.col("row")).alias("id"), F.col("doc.text").alias("text"))), "signatures")
    least = signed.groupBy("digest").agg(F.min(F.struct("id", "n", "keys")).alias("least"))
    classes = cut(least.select("digest", "least.id", "least.n", "least.keys"), "classes")
    rows = boxed.select("row", F.col("doc.text").cast("binary").alias("text"))
    groups = cut(links(classes.select("id.row", "n", "keys"), rows), "groups")
    grouped = classes.select("id").join(groups, groups.node == F.col("id.row")).select("id", "root")
    first = grouped.groupBy("root").agg(F.min("id").alias("first"))
    worse = grouped.join(first, "root").where("id <> first").select("id.row")
    copies = signed.select("id.row").join(classes.select("id.row"), "row", "left_anti")
    return boxed.join(bounded(worse.union(copies), name="dropped"), "row", "left_anti").select("doc.*")
