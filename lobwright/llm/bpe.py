"""Byte-pair encoding and decoding by an index of pair occurrences.

The distinct pieces of many texts are laid out as one sequence of symbols with breaks between.  An index maps the rank of each
pair that can be merged to all its places.  Active ranks are taken in ascending order; all places of a rank are merged at once, and
only the lists of the pairs beside them are updated.  A piece is thus merged in its own order of ranks, however many pieces
share the sequence, and a rank costs as much as it has places.

Byte-pair tokenizers never merge across the pieces that their pre-tokenizer cuts, so a piece is merged once for all the texts
that hold it.  Where the pre-tokenizer drops white space, texts are cut there first, and what a run of characters becomes is
remembered: two generations of runs, so that common ones stay when rare ones go.  The vocabulary, its normalizer and its
pre-tokenizer come from a file of the ``tokenizers`` library; the library's model takes no part.

Null texts are empty and give no ids; empty and repeated texts are texts like others.  The strings of special tokens in a text
become those tokens, as in the library's default call.  Very long texts are encoded in whole.  Extra columns stay in ``row``.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lobwright.llm.memory import Remembered

#: Runs and pieces of a generation that a worker remembers.
REMEMBERED = 150_000

#: Bytes of text whose pieces are indexed together.
BLOCK = 2_000_000

#: Runs that go to the pre-tokenizer in one call.
TOGETHER = 1024

#: A word of Latin letters and marks after it, which common pre-tokenizers cut apart.
MARKED = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,!?:;]+)")

_BREAK, _GONE = -1, -2


class PairIndex:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
        if model["type"] != "BPE" or any((model.get(k) or v) != v for k, v in plain.items()):
            raise ValueError(f"{path}: only plain byte-pair models are supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: special tokens that take their surroundings are not supported")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = {t: i for t, i in vocab.items() if len(t) == 1}
        self.last = {t[:-len(suffix)]: i for t, i in vocab.items() if t.endswith(suffix) and len(t) == len(suffix) + 1} if suffix else self.inner
        self.size = max(vocab.values()) + 2  # the break, -1, is the last symbol modulo this
        self.merges = []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
        self.ranks = {a * self.size + b: rank for rank, (a, b, _) in enumerate(self.merges)}
        earliest: dict[int, int] = {}
        for rank, (a, b, _) in reversed(list(enumerate(self.merges))):
            earliest[a] = earliest[b] = rank
        if any(earliest.get(t, rank + 1) <= rank for rank, (_, _, t) in enumerate(self.merges)):
            raise ValueError(f"{path}: a merge uses a token before the merge that makes it")
        self.pairs = np.array(sorted(self.ranks), dtype=np.int64)
        self.pair_ranks = np.array([self.ranks[p] for p in self.pairs.tolist()], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in added}
        self.special_pattern = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if added else None
        self.tokens: list[str | None] = [None] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.decoder = (spec.get("decoder") or {}).get("type")
        self.cuts = self._cut("a  b\t\nc\r d\x0b\x0ce") == self._cut("a b c d e")
        self.cuts_marks = all(self._cut("ab" + m) == self._cut("ab") + self._cut(m) for m in (".", ",", "!", "?", ":", ";", ".,", ";!?:"))
        self.runs, self.pieces = Remembered(REMEMBERED), Remembered(REMEMBERED)

    def _cut(self, text: str) -> list[str]:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [piece for piece, _ in self.pre_tokenizer.pre_tokenize_str(text)] if self.pre_tokenizer is not None else [text]

    def merged(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of ``pieces``, all in one sequence."""
        size, inner, last = self.size, self.inner, self.last
        symbols: list[int] = []
        for piece in pieces:
            symbols += map(inner.__getitem__, piece[:-1])
            symbols += last[piece[-1]], _BREAK
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places = self._index(symbols)
        active = list(places)
        heapq.heapify(active)
        rank_of = self.ranks.get
        while active:
            rank = heapq.heappop(active)
            a, b, made = self.merges[rank]
            for at in sorted(places.pop(rank)):
                right = after[at]
                if symbols[at] != a or symbols[right] != b:
                    continue  # a place that an earlier merge has taken
                symbols[at], symbols[right] = made, _GONE
                beyond = after[at] = after[right]
                before[beyond] = at
                met = rank_of(made * size + symbols[beyond])
                if met is not None:
                    if met in places:
                        places[met].append(at)
                    else:
                        places[met] = [at]
                        heapq.heappush(active, met)
                left = before[at]
                met = rank_of(symbols[left] * size + made) if left >= 0 else None
                if met is not None:
                    if met in places:
                        places[met].append(left)
                    else:
                        places[met] = [left]
                        heapq.heappush(active, met)
        ids = np.array(symbols, dtype=np.int64)
        ends = np.cumsum(ids >= 0)[ids == _BREAK].tolist()
        raw = ids[ids >= 0].astype("<u4").tobytes()
        return [raw[4 * x : 4 * y] for x, y in zip([0, *ends], ends)]

    def _index(self, symbols: list[int]) -> dict[int, list[int]]:
        """Places of each pair that can be merged, by its rank."""
        s = np.array(symbols, dtype=np.int64)
        keys = s[:-1] * self.size + s[1:]
        found = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        at = np.flatnonzero((self.pairs[found] == keys) & (s[:-1] >= 0) & (s[1:] >= 0))
        ranks = self.pair_ranks[found[at]]
        order = np.argsort(ranks, kind="stable")
        names, starts = np.unique(ranks[order], return_index=True)
        return dict(zip(names.tolist(), map(np.ndarray.tolist, np.split(at[order], starts[1:])), strict=True)) if len(at) else {}

    def _cut_plain(self, runs: list[str]) -> Iterator[list[str]]:
        """The pieces of each of ``runs``, which hold no white space: cut together, then told apart by where they begin."""
        text = " ".join(runs)
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        ends = np.cumsum([len(t) + 1 for t in text.split(" ")])
        if len(ends) != len(runs) or self.pre_tokenizer is None:
            yield from map(self._cut, runs)
            return
        found = self.pre_tokenizer.pre_tokenize_str(text)
        starts = np.fromiter((place[0] for _, place in found), dtype=np.int64, count=len(found))
        upto = np.searchsorted(starts, ends).tolist()
        pieces = [piece for piece, _ in found]
        yield from (pieces[x:y] for x, y in zip([0, *upto], upto))

    def _parts(self, text: str) -> list[str | int]:
        """The pieces of a run or text of any kind, and the ids of the special tokens in it."""
        found: list[str | int] = []
        at = 0
        for hit in self.special_pattern.finditer(text) if self.special_pattern is not None else ():
            found += [*(self._cut(text[at : hit.start()]) if hit.start() > at else []), self.special[hit.group()]]
            at = hit.end()
        return found + (self._cut(text[at:]) if at < len(text) else [])

    def _learn(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each of ``runs``."""
        texts = [run.decode() for run in runs]
        marked = {t: hit.groups() for t in texts if (hit := MARKED.fullmatch(t))} if self.cuts and self.cuts_marks else {}
        alone = list({*(t for t in texts if t not in marked), *(x for both in marked.values() for x in both)})
        plain = [t for t in alone if self.cuts and len(t.split()) == 1 and not (self.special_pattern is not None and self.special_pattern.search(t))]
        parts: dict[str, list] = {}
        for at in range(0, len(plain), TOGETHER):
            parts.update(zip(plain[at : at + TOGETHER], self._cut_plain(plain[at : at + TOGETHER]), strict=True))
        parts.update((t, self._parts(t)) for t in set(alone).difference(parts))
        new = self.pieces.missing({p for found in parts.values() for p in found if isinstance(p, str) and p})
        known = self.pieces.young
        known.update(zip(new, self.merged(new), strict=True))
        found = {t: b"".join([known[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in found if p != ""]) for t, found in parts.items()}
        return {run: found[marked[t][0]] + found[marked[t][1]] if t in marked else found[t] for run, t in zip(runs, texts, strict=True)}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        if not self.cuts:
            found = self._learn(list(set(texts)))
            return [found[t] for t in texts]
        cut = [t.split() for t in texts]
        new = self.runs.missing(set().union(*cut))
        self.runs.young.update(self._learn(new))
        get = self.runs.young.__getitem__
        return [b"".join(map(get, runs)) for runs in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids as the library's decoder gives it; ids outside the vocabulary are skipped."""
        found = np.frombuffer(ids, dtype="<u4")
        tokens = [t for t in map(self.tokens.__getitem__, found[found < len(self.tokens)].tolist()) if t is not None]
        if self.decoder is None:
            return " ".join(tokens)
        if self.decoder == "ByteLevel":
            return b"".join(map(_token_bytes, tokens)).decode("utf-8", "replace")
        raise ValueError(f"decoder {self.decoder} is not supported")


@lru_cache(maxsize=1)
def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(0x100 + k): b for k, b in enumerate(hidden)}}


@lru_cache(maxsize=100_000)
def _token_bytes(token: str) -> bytes:
    letters = _byte_letters()
    return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()


@lru_cache(maxsize=2)
def pair_index(path: str) -> PairIndex:
    """One per worker process and vocabulary."""
    return PairIndex(path)


def _others(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != column]).alias("row"), F.col(f"`{column}`").alias("value"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about ``BLOCK`` bytes, or of one value that is longer, and their values."""
    for batch in batches:
        sizes = pc.coalesce(pc.binary_length(batch.column("value")), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            part = batch.slice(x, y - x)
            yield part, [v or b"" for v in part.column("value").to_pylist()]


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(row, ids): ``ids`` are the bytes of each whole text's token ids, ``row`` the other columns of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pair_index(path)
        for batch, texts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(index.encode(texts), pa.binary())], names=["row", "ids"])

    rows = _others(docs, text).select("row", F.coalesce("value", F.lit("")).cast("binary").alias("value"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("ids", T.BinaryType())]))


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """(row, ids, decoded): ``decoded`` is the text of ``ids``; null ids are those of an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pair_index(path)
        for batch, ids in _blocks(batches):
            decoded = pa.array(map(index.decode, ids), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("value"), decoded], names=["row", "ids", "decoded"])

    rows = _others(encoded, ids)
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each of ``docs`` (doc_id, text)."""
    back = decode_ids(encode_texts(docs.select("doc_id", "text"), path), path)
    return back.select("row.row.doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
