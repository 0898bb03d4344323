"""Vector codes: each of 16 parts of a vector is replaced by the number of its nearest codebook entry.

Components become integers (``floor(SCALE * x)``), so that every sum and distance is exact and no order of summation matters.
The nearest entry is found by equal-average search.  Entries are sorted by the sum of their components; a part starts at its own
sum and looks outward on both sides.  By Cauchy-Schwarz the squared gap of two sums, divided by the dimension, never exceeds the
squared distance; a side is finished once that bound is strictly above the best distance so far, so equal distances are still
seen and the lower index wins.

Training passes over all vectors; a worker sends only sums and counts per (part, entry), at most ``parts * entries`` rows a
batch, and codebooks of that size come to the driver.

Rows whose vector is null, or holds null or non-finite components, are dropped.  Other rows stay: a vector that is empty, has
another length than the first that can be encoded, a length that no equal parts divide, or a component beyond ``largest`` has a
null code and error and takes no part in training.  Equal rows count each; null ids sort last.  Fewer vectors than entries give a
shorter codebook, an empty table no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobwright.llm.common import bounded
from lobwright.sources.stages import cut

#: Parts, entries, rounds of training, integer steps per unit.
PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256

#: Vectors that are searched together.
SLICE = 1 << 13

#: Copies of the table of label sums when it is too large to broadcast: rows of a label are dealt over so many keys.
SALTS = 16


def largest(dim: int) -> int:
    """The largest component (in steps) that is encoded: squared distances times ``dim``, the part's length, stay below 2**62."""
    return (1 << 24) * 64 // max(dim, 64)


def integers(vectors: pa.ListArray, length: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(fit, values): which vectors can be encoded, and their integer components."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    fit = sizes == length
    flat = np.asarray(pc.list_flatten(vectors.filter(pa.array(fit))).to_numpy(zero_copy_only=False), dtype=np.float64)
    steps = np.floor(flat * SCALE).reshape(-1, length)
    small = (np.abs(steps) <= limit).all(axis=1)
    fit[np.flatnonzero(fit)[~small]] = False
    return fit, steps[small].astype(np.int64)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each row of ``parts``; equal distances go to the lower index."""
    dim, k = parts.shape[1], len(entries)
    order = np.argsort(entries.sum(axis=1), kind="stable")
    ranked = entries[order]
    sums, own = ranked.sum(axis=1), parts.sum(axis=1)
    start = np.searchsorted(sums, own)
    best = np.full(len(parts), (1 << 62) // dim)
    index = np.full(len(parts), k)
    for side in (1, -1):
        # The upper side first; what it leaves as the best distance ends the lower side sooner.
        at = start.copy() if side == 1 else start - 1
        live = np.flatnonzero((at >= 0) & (at < k))
        while len(live):
            gap = own[live] - sums[at[live]]
            live = live[gap * gap <= best[live] * dim]
            place = at[live]
            away = ((parts[live] - ranked[place]) ** 2).sum(axis=1)
            name = order[place]
            better = (away < best[live]) | ((away == best[live]) & (name < index[live]))
            best[live[better]], index[live[better]] = away[better], name[better]
            at[live] += side
            live = live[(at[live] >= 0) & (at[live] < k)]
    return index, best


def _searched(values: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, distances), a column per part."""
    parts = values.reshape(len(values), codebooks.shape[0], codebooks.shape[2])
    found = [nearest(parts[:, p], codebooks[p]) for p in range(codebooks.shape[0])]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def kept_vectors(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is there and holds only finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(F.col(vector).isNotNull() & F.forall(vector, finite))


def fit_codebooks(kept: DataFrame, key: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks [part, entry, component] of ``kept``; None if no vector can be encoded.

    Entries start as the parts of the vectors with the smallest keys (null keys last, equal keys by their components).
    """
    scaled = lambda x: F.floor(x.cast("double") * SCALE).cast("double")
    usable = kept.select(F.col(key).alias("k"), F.col(vector).alias("v")).where((F.size("v") > 0) & (F.size("v") % parts == 0))
    fits = usable.where(F.forall("v", lambda x: F.abs(scaled(x)) <= F.lit(1 << 24) * 64 / F.greatest(F.size("v") / parts, F.lit(64))))
    ordered = [F.asc_nulls_last("k"), F.asc("v")]
    first = fits.orderBy(*ordered).first()
    if first is None:
        return None
    length = len(first.v)
    dim = length // parts
    seeds = fits.where(F.size("v") == length).orderBy(*ordered).limit(entries).collect()
    books = np.floor(np.array([r.v for r in seeds], dtype=np.float64) * SCALE).astype(np.int64).reshape(len(seeds), parts, dim).transpose(1, 0, 2)
    size = len(seeds)
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    _, values = integers(batch.column("v").slice(at, SLICE), length, largest(dim))
                    codes, _ = _searched(values, books)
                    split = values.reshape(len(values), parts, -1)
                    cell = (codes + np.arange(parts) * size).reshape(-1)
                    seen = np.bincount(cell, minlength=parts * size)
                    total = np.zeros((parts * size, split.shape[2]), dtype=np.int64)
                    np.add.at(total, cell, split.reshape(len(cell), -1))
                    used = np.flatnonzero(seen)
                    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cell", "n", "total"])

        sums = kept.select(F.col(vector).alias("v")).mapInArrow(run, "cell int, n long, total array<long>").groupBy("cell").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"t{d}") for d in range(dim)])
        books = books.copy()
        for row in sums.toLocalIterator():
            books[row.cell // size, row.cell % size] = [int(row[f"t{d}"]) // row.n for d in range(dim)]
    return books


def encode(kept: DataFrame, vector: str, books: np.ndarray | None) -> DataFrame:
    """(row, code, error): ``row`` holds the other columns of ``kept``, ``code`` two hex digits a part."""
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns if c != vector]).alias("row"), F.col(vector).alias("v"))
    if books is None:
        return rows.select("row", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = [f"{i:02x}" for i in range(books.shape[1])]
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                fit, values = integers(batch.column("v"), books.shape[0] * books.shape[2], largest(books.shape[2]))
                codes, away = _searched(values, books)
                texts, errors = np.full(len(fit), None, dtype=object), np.full(len(fit), None, dtype=object)
                texts[fit] = ["".join(map(digits.__getitem__, c)) for c in codes.tolist()]
                errors[fit] = away.sum(axis=1).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts.tolist(), pa.string()), pa.array(errors.tolist(), pa.int64())], names=["row", "code", "error"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def decode(codes: DataFrame, code: str, books: np.ndarray) -> DataFrame:
    """``codes`` with ``decoded``: the codebook entries that a code names, joined, as numbers of the original scale."""
    literal = F.array(*[F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in entry]) for entry in part]) for part in books])
    at = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("decoded", F.when(F.col(code).isNotNull(), F.flatten(F.array(*[literal[p][at(p)] for p in range(len(books))]))))


def book_digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components in order of part, entry and place, comma-joined; of an empty text without codebooks."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()


def vector_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every kept row; equal labels share their summed error."""
    kept = kept_vectors(df, vector)
    books = fit_codebooks(kept, key, vector)
    coded = cut(encode(kept.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")), "vector", books).select(
        "row.key", "row.label", "code", "error"), "vector_codes")
    sums = bounded(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), name="label_errors")
    spread = coded.withColumn("salt", F.pmod(F.xxhash64("key", "code"), F.lit(SALTS)))
    salted = sums.withColumnRenamed("label", "named").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(salted, F.col("label").eqNullSafe(F.col("named")) & (F.col("salt") == F.col("s"))).select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))
