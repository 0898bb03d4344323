"""Collocations: phrases of two to five words whose words stand together more often than their parts would by chance.

Counting is by marginalising the longest windows.  Each word of a piece opens one window of ``LONGEST`` lead columns, padded
where the piece ends; only these windows are counted, and one ``rollup`` over the lead columns sums them to the counts of all
shorter phrases, since every occurrence of a phrase is the beginning of exactly one window.

A window is padded earlier where no phrase of at least ``least`` occurrences can go on: at a word below ``least``, and between
two neighbours that stand side by side fewer than ``least`` times.  A phrase is at most as frequent as any two neighbours in
it, so no count that matters changes, and most windows of a corpus fall together.

Words are numbered; the numbers of at most ``WORDS`` frequent words go to the workers, which then cut, number and pad the text
by arrays.  With more frequent words than that, words are numbered by a join and led by window functions: the same result.

Null languages count as ``und``, null texts as empty.  Equal rows count each.  An empty table, or one without frequent phrases,
gives no rows.  A text of any length is read in whole; no more than ``BLOCK`` characters are held as words at a time, or one text.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobwright.llm.common import bounded, lower_ascii
from lobwright.sources.stages import cut

#: Words of the longest phrase.
LONGEST = 5

#: Frequent words, and frequent pairs of neighbours, that are handed to the workers; beyond, joins take their place.
WORDS = 1_000_000
PAIRS = 4_000_000

#: Characters of text that are cut into words together.
BLOCK = 2_000_000

#: Different words that a task counts before it passes the counts on.
HELD = 150_000

#: Different pairs or windows that a task holds before it passes their counts on.
COMBINED = 400_000

#: Groups of phrases that are ranked apart before the best of each are ranked together.
RANK_BLOCKS = 64

#: Ends of pieces, and white space between words.
PIECE_ENDS = r"[.,;:!?\x0A-\x0D]"
GAPS = r"[\x20\x09]+"

LEADS = [f"w{k}" for k in range(1, LONGEST + 1)]

_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words) of the texts in blocks, a line feed between pieces and nothing for a doubled space."""
    def cut_up(texts: list[bytes]) -> list[bytes]:
        return b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ").split(b" ")

    held: dict[str, list[bytes]] = {}
    size: Counter[str] = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = text.as_py()
            held.setdefault(lang, []).append(text)
            size[lang] += len(text)
            if size[lang] > BLOCK or len(held) > 1000:
                yield lang, cut_up(held.pop(lang))
                size[lang] = 0
    while held:
        lang, texts = held.popitem()
        yield lang, cut_up(texts)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of all words of ``texts`` (lang, text as bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for lang, counted in found.items():
                counted.pop(b"", None)
                counted.pop(b"\n", None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counted), pa.string()), pa.array(list(counted), pa.binary()).cast(pa.string()), pa.array(list(counted.values()), pa.int64())],
                    names=["lang", "word", "n"])
            found.clear()

        found: dict[str, Counter] = {}
        for lang, words in _blocks(batches):
            found.setdefault(lang, Counter()).update(words)
            if sum(map(len, found.values())) > HELD:
                yield from out()
        yield from out()

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _numbered(batches: Iterator[pa.RecordBatch], numbers: dict[str, dict[bytes, int]]) -> Iterator[np.ndarray]:
    """Numbers of the words of each block, 0 for ends of pieces and words that are not frequent."""
    for lang, words in _blocks(batches):
        known = {**numbers.get(lang, {}), b"": -1}
        found = np.fromiter(map(known.get, words, itertools.repeat(0)), dtype=np.int64, count=len(words))
        yield found[found >= 0]


def _combined(tables: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of ``tables`` (keys) counted as (keys, n), over as many tables as fit."""
    held: list[pa.Table] = []
    rows = 0

    def merge() -> pa.Table:
        summed = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("n", "sum")])
        return summed.rename_columns({"n_sum": "n"}).select([*keys, "n"])

    for table in tables:
        counted = table.group_by(keys, use_threads=False).aggregate([([], "count_all")])
        held.append(counted.rename_columns({"count_all": "n"}).select([*keys, "n"]))
        rows += held[-1].num_rows
        if rows > 2 * COMBINED:
            held = [merge()]
            rows = held[0].num_rows
            if rows > COMBINED:
                yield from held.pop().to_batches(max_chunksize=100_000)
                rows = 0
    if held:
        yield from merge().to_batches(max_chunksize=100_000)
    held.clear()
    pa.default_memory_pool().release_unused()  # the worker goes on to other stages


def _array_pairs(texts: DataFrame, numbers) -> DataFrame:
    """(pair, n) of neighbours, two word numbers in one integer, not yet summed up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.Table]:
            for ids in _numbered(batches, numbers.value):
                both = (ids[:-1] != 0) & (ids[1:] != 0)
                yield pa.table({"pair": (ids[:-1][both] << 32) | ids[1:][both]})

        yield from _combined(found(), ["pair"])

    return texts.mapInArrow(run, "pair long, n long")


def _array_windows(texts: DataFrame, numbers, pairs) -> DataFrame:
    """(w1 .. w5, n): padded windows, counted per block of text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.Table]:
            for ids in _numbered(batches, numbers.value):
                ids = np.append(ids, 0)
                goes_on = (ids[:-1] != 0) & (ids[1:] != 0)
                if pairs is not None:
                    known, at = pairs.value, np.flatnonzero(goes_on)
                    pair = (ids[at] << 32) | ids[at + 1]
                    place = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                    goes_on[at] = known[place] == pair if len(known) else False
                columns, running = [ids[:-1]], np.ones(len(ids) - 1, dtype=bool)
                for k in range(1, LONGEST):
                    running = running & np.append(goes_on, np.zeros(k - 1, dtype=bool))[k - 1 :]
                    columns.append(np.where(running, np.append(ids, np.zeros(k, dtype=ids.dtype))[k : k + len(running)], 0))
                opens = columns[0] != 0
                yield pa.table({w: pa.array(c[opens].astype(np.int32)) for w, c in zip(LEADS, columns)})

        yield from _combined(found(), LEADS)

    return texts.mapInArrow(run, ", ".join(f"{w} int" for w in LEADS) + ", n long")


def _joined_windows(texts: DataFrame, numbers: DataFrame, least: int) -> DataFrame:
    """(w1 .. w5, n) without handing anything to the workers: numbers and frequent pairs come by joins, leads by windows."""
    rows = texts.select("lang", lower_ascii(F.col("text").cast("string")).alias("text"), F.monotonically_increasing_id().alias("row"))
    pieces = cut(rows.select("row", "lang", F.posexplode(F.split("text", PIECE_ENDS)).alias("piece", "body")).select(
        "row", "lang", "piece", F.posexplode(F.array_remove(F.split("body", GAPS), "")).alias("at", "word")), "phrase_words")
    placed = pieces.join(numbers.select("lang", "word", "id"), ["lang", "word"], "left").select("row", "piece", "at", F.coalesce("id", F.lit(0)).alias("w1"))
    along = Window.partitionBy("row", "piece").orderBy("at")
    led = cut(placed.select("row", "piece", "at", "w1", *[F.coalesce(F.lead("w1", k).over(along), F.lit(0)).alias(f"w{k + 1}") for k in range(1, LONGEST)]), "leads")
    frequent = led.where("w1 <> 0 and w2 <> 0").groupBy("w1", "w2").count().where(F.col("count") >= least).select("w1", "w2", F.lit(True).alias("goes_on"))
    padded = led.where("w1 <> 0").join(frequent, ["w1", "w2"], "left").select(
        "w1", *[F.when(F.col("goes_on") & (F.array_position(F.array(*LEADS), 0) == 0), F.col(w)).when(
            F.col("goes_on") & (F.array_position(F.array(*LEADS), 0) > k), F.col(w)).otherwise(0).alias(w) for k, w in enumerate(LEADS[1:], 2)])
    return padded.groupBy(*LEADS).agg(F.count("*").alias("n"))


def phrase_counts(windows: DataFrame, least: int) -> DataFrame:
    """(phrase, f): all beginnings of the windows (w1 .. w5, n) with at least ``least`` occurrences, as arrays of word numbers."""
    counted = windows.groupBy(*LEADS).agg(F.sum("n").alias("n"))
    summed = counted.rollup(*LEADS).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # Bits of grouping_id stand for the columns summed over, the last column in the lowest bit.
    size = F.lit(LONGEST) - F.bit_count("level")
    return summed.where(F.col("f") >= least).select(F.slice(F.array(*LEADS), 1, size.cast("int")).alias("phrase"), "f").where(
        (F.size("phrase") > 0) & (F.element_at("phrase", -1) != 0))


def _score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """``floor(1000 * a * n / (l * r))`` in decimals: exact up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), (wide(l) * wide(r)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, absorb: int = 100, words: int = WORDS, pairs: int = PAIRS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): per language the ``top`` best of the phrases with ``a >= least`` occurrences.

    ``l`` and ``r`` count the two parts at the cut with the lowest score.  A phrase goes if a longer frequent one that holds
    it has at least ``absorb`` percent of its occurrences.  Such a longer phrase has one of one word more between (at least as
    frequent), so only those need be looked at.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = cut(word_counts(texts), "word_counts")
    totals = bounded(counts.groupBy("lang").agg(F.sum("n").alias("n")), name="language_totals")
    numbers, size = _number(counts.where(F.col("n") >= least))
    spark, share = docs.sparkSession, docs.sparkSession.sparkContext.broadcast
    if size <= words:
        known: dict[str, dict[bytes, int]] = {}
        for lang, word, at in numbers.select("lang", F.col("word").cast("binary"), "id").toLocalIterator():
            known.setdefault(lang, {})[bytes(word)] = at
        shared = share(known)
        frequent = cut(_array_pairs(texts, shared).groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("pair"), "frequent_pairs")
        goes_on = share(np.sort(np.array([x for x, in frequent.collect()], dtype=np.int64))) if frequent.count() <= pairs else None
        windows = _array_windows(texts, shared, goes_on)
    else:
        windows = _joined_windows(texts, numbers, least)
    phrases = cut(phrase_counts(windows, least), "phrases")
    known_phrases = bounded(phrases, name="known_phrases")
    several = phrases.where(F.size("phrase") > 1).select("phrase", F.col("f").alias("a"))
    side = lambda name, count: known_phrases.select(F.col("phrase").alias(name), F.col("f").alias(count))
    longer = several.where(F.size("phrase") > 2).select(
        F.explode(F.array(F.slice("phrase", 1, F.size("phrase") - 1), F.slice("phrase", 2, F.size("phrase") - 1))).alias("phrase"), "a").groupBy(
        "phrase").agg(F.max("a").alias("longer"))
    kept = several.join(longer, "phrase", "left").where(f"longer is null or 100 * longer < {int(absorb)} * a").select("phrase", "a")
    first = numbers.select(F.col("id"), "lang")
    placed = kept.withColumn("id", F.col("phrase")[0]).join(bounded(first, name="languages"), "id").join(totals, "lang")
    cuts = placed.select("lang", "phrase", "a", "n", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k")).select(
        "*", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")).alias("right"))
    scored = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right").withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
    named = lowest.select("lang", F.posexplode("phrase").alias("at", "id"), "phrase", "a", "n", "least").join(
        bounded(numbers.select("id", "word"), name="spelling"), "id").groupBy("lang", F.col("phrase").alias("ids"), "a", "n", "least").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = named.select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_BLOCKS)).alias("block"))
    best = flat.withColumn("place", F.row_number().over(Window.partitionBy("lang", "block").orderBy(*order))).where(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _number(frequent: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, n, id) with ids from 1 without gaps, and how many there are: rows before the partition, then its own."""
    parted = cut(frequent.withColumn("row", F.monotonically_increasing_id()), "frequent_words")
    part = F.shiftright("row", 33)
    sizes = parted.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(sizes.select("part", "size", before.alias("before")), "word_offsets")
    numbers = parted.join(F.broadcast(offsets.select("part", "before")), part == F.col("part")).select(
        "lang", "word", "n", (F.col("before") + F.col("row") - F.shiftleft("part", 33) + 1).cast("int").alias("id"))
    return cut(numbers, "word_numbers"), offsets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
