"""Documents that hold passages of a benchmark, by spaced seeds.

A seed is a fixed mask over ``SPAN`` token positions; its hash takes the tokens under the ones and ignores the rest, so two
passages share it even if tokens at the ignored places were replaced.  Hashes of the benchmark's positions are joined with
those of all positions of all documents.  A hit fixes a document, an item and a shift between their tokens; around it the
two are compared token by token, and the stretch with the best score (one point for an equal token, three off for another)
is the overlap.  It is a leak if it has ``LEAST`` equal tokens, or ``SHARE`` of a shorter item's, at three quarters of its
length or more.  With three masks of five ones, a passage of 13 tokens of which every fifth is replaced is still met by
one of them at some position; exact passages always are.

Tokens are runs of letters and digits, lower-cased.  Items of fewer than ``SPAN`` tokens, null or empty items and documents
match nothing; repeated rows are one pair; an empty table gives no pairs; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobwright.llm.common import bounded, let, row_key, token_hashes
from lobwright.sources.stages import cut

#: The masks, as the positions that count.
SPAN = 8
MASKS = ((0, 1, 2, 4, 7), (0, 1, 3, 6, 7), (0, 2, 3, 5, 6))

LEAST = 13
SHARE = 0.8
MISMATCH = 3


def seed_hashes(tokens: Column) -> Column:
    """Array of the hashes of every mask at every position: number ``pos * len(MASKS) + k`` is mask k's at ``pos``."""
    at = lambda i: F.array(*[F.xxhash64(F.lit(k), *[F.get(tokens, i + p) for p in mask]) for k, mask in enumerate(MASKS)])
    return F.when(F.size(tokens) >= SPAN, F.flatten(F.transform(F.sequence(F.lit(0), F.size(tokens) - SPAN), at)))


def overlap(doc: Column, item: Column, shift: Column) -> Column:
    """Struct (matched, less, at) of the best stretch of ``item`` along the shift: ``less`` is minus its length, ``at`` minus its first position.

    Of the stretches whose score is not negative, the one with most equal tokens, then the shortest, then the first.  A best one
    begins and ends with an equal token.  For an end, the earliest start whose prefix score is not above the end's has most; it
    is always one at which the prefix score was lower than at all starts before, so only those are kept in ``starts``.
    """
    def step(state: Column, i: Column) -> Column:
        p, m, low = state["p"], state["m"], state["low"]

        def ended(starts: Column) -> Column:
            def grown(s: Column) -> Column:
                here = F.struct((m + 1 - s["m"]).alias("matched"), (s["i"] - i - 1).alias("less"), (-s["i"]).alias("at"))
                return F.struct((p + 1).alias("p"), (m + 1).alias("m"), F.least(low, p).alias("low"), starts.alias("starts"), F.greatest(state["best"], here).alias("best"))

            return let(F.get(F.filter(starts, lambda s: s["p"] <= p + 1), F.lit(0)), grown)

        opened = F.when(p < low, F.concat(state["starts"], F.array(F.struct(p.alias("p"), m.alias("m"), i.alias("i"))))).otherwise(state["starts"])
        missed = F.struct((p - MISMATCH).alias("p"), m.alias("m"), low.alias("low"), state["starts"].alias("starts"), state["best"].alias("best"))
        return F.when(F.get(doc, i + shift) == F.get(item, i), let(opened, ended)).otherwise(missed)

    zero = F.lit(0)
    start = F.struct(zero.alias("p"), zero.alias("m"), F.lit(1).alias("low"), F.array().cast("array<struct<p:int,m:int,i:int>>").alias("starts"),
                     F.struct(zero.alias("matched"), zero.alias("less"), zero.alias("at")).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), start, step, lambda state: state["best"])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, doc_id, item_id, start, length, matched, item_tokens): the best overlap of each document and item that is a leak.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.  ``start`` and ``length`` count the document's tokens.  The
    hashes of the benchmark are counted before they are broadcast.  Documents are read twice: narrow rows of hashes first,
    then the texts of those with hits only.
    """
    items = bounded(benchmark.select("item_id", token_hashes(F.col("text")).alias("item")).where(F.size("item") >= SPAN).distinct(), name="items")
    pos = F.floor(F.col("number") / len(MASKS)).cast("int")
    marks = cut(items.select("item_id", F.posexplode(seed_hashes(F.col("item"))).alias("number", "hash")).select(
        "hash", "item_id", pos.alias("item_pos")), "seed_marks")
    known = bounded(marks.select("hash").distinct(), name="seed_hashes")
    marks = bounded(marks.distinct(), name="seed_places")
    seeds = docs.select(row_key().alias("key"), F.posexplode(let(token_hashes(F.col("text")), seed_hashes)).alias("number", "hash"))
    hits = seeds.join(known, "hash", "left_semi").join(marks, "hash")
    shifts = cut(hits.select("key", "item_id", (pos - F.col("item_pos")).alias("shift")).distinct(), "seed_hits")
    wanted = bounded(shifts.select("key").distinct(), name="seed_documents")
    texts = docs.select(row_key().alias("key"), "doc_id", "text").join(wanted, "key", "left_semi").select(
        "key", "doc_id", token_hashes(F.col("text")).alias("doc"))
    aligned = texts.join(shifts, "key").join(items, "item_id").select(
        "key", "doc_id", "item_id", "shift", F.size("item").alias("n"), overlap(F.col("doc"), F.col("item"), F.col("shift")).alias("o"))
    found = aligned.select("key", "doc_id", "item_id", (F.col("shift") - F.col("o.at")).alias("start"), (-F.col("o.less")).alias("length"),
                           F.col("o.matched").alias("matched"), F.col("n").alias("item_tokens"))
    least = F.least(F.lit(LEAST), F.ceil(SHARE * F.col("item_tokens")))
    leaks = found.where((F.col("matched") >= least) & (4 * F.col("matched") >= 3 * F.col("length")))
    best = F.struct("matched", -F.col("start"), "length", "item_tokens", "start")
    return leaks.groupBy("key", "doc_id", "item_id").agg(F.max(best).alias("b")).select(
        "key", "doc_id", "item_id", "b.start", "b.length", "b.matched", "b.item_tokens")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The leaks as (doc_id, item_id, start, length, matched, item_tokens)."""
    return find_leaks(docs, benchmark).drop("key").groupBy("doc_id", "item_id").agg(
        F.max(F.struct("matched", -F.col("start"), "length", "item_tokens", "start")).alias("b")).select(
        "doc_id", "item_id", "b.start", "b.length", "b.matched", "b.item_tokens")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of the benchmark."""
    leaks = bounded(find_leaks(docs, benchmark).select("key").distinct(), name="leaks")
    boxed = docs.select(row_key().alias("key"), F.struct("*").alias("doc"))
    return boxed.join(leaks, "key", "left_anti").select("doc.*")
