"""Token ids of whole texts, by the ``tokenizers`` library.

A byte-pair tokenizer never merges across the pieces that its pre-tokenizer cuts, and both kinds used here cut at a single
space between two other characters.  So a text is split there, the library encodes each distinct piece once, and the ids of
a text are the joined ids of its pieces: the same ids as for the whole text, at a fraction of the time, since words recur.
So do a word and the full stop after it, which are two pieces.
Texts with neighbouring white space, where the cut depends on what follows, go to the library whole.  So do pieces that hold the
string of a special token, which by the library's default becomes that token; with ``special_as_text`` it is ordinary text.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from unicodedata import normalize

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from lobwright.llm.memory import Remembered

# One thread per Spark task; Spark runs the tasks side by side.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Two characters of white space side by side.
_NEIGHBOURS = re.compile(r"\s\s")

#: Marks after a word; the pre-tokenizers cut before them.
_MARKS = ".,!?:;#*$%&"

#: A piece that stands for a full stop right after a letter or digit, where the pre-tokenizers cut.  No text has it: a line feed begins a piece.
_STOP = ".\n"

#: A full stop after anything else.  Only Latin letters count that the normalizer leaves one letter (not U+0130).
_APART = re.compile(r"\. (?<![0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]\. )")

#: Pieces of a generation that a worker remembers.
CACHE_PIECES = 700_000

#: Words that go to the library as one text.
RUN = 64


class Encoder:
    """Encodes texts as bytes: little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, special_as_text: bool = False):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        ids = lambda t: self.library.encode(t, add_special_tokens=False).ids
        self.drops_space = ids("a  b") == ids("a b")
        self.lower = self._without_normalizer(path) if self.drops_space and ids("\u00c9 B") == ids("\u00e9 b") else None
        # Each word of letters has one token that starts with the space or line feed before it, or one that ends a word.
        tokens = self.library.get_vocab()
        self.edge = np.zeros(max(tokens.values()) + 1, dtype=bool)
        self.edge[[i for t, i in tokens.items() if (t.endswith("</w>") if self.drops_space else t.startswith(("\u0120", "\u010a")))]] = True
        self.inner = Remembered(CACHE_PIECES)  # pieces after a space; those that begin with a line feed stand for themselves
        self.opening: dict[str, bytes] = {}  # pieces with nothing before them
        self.stop = self._whole(["."])[0]

    @staticmethod
    def _without_normalizer(path: str) -> Tokenizer:
        """The same model for words of letters that are normalized already, with a space between."""
        bare = Tokenizer(Tokenizer.from_file(path).model)
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return bare

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[list[str]]) -> list:
        """The library's encodings of words of letters side by side; Latin-1 is composed, so it only needs lower case."""
        texts = ["".join(map(_placed, r)) for r in runs]
        if self.lower is None:
            return self.library.encode_batch_fast(texts, add_special_tokens=False)
        plain = [_latin(t) for t in texts]
        lowered = iter(self.lower.encode_batch_fast([t.lower() for t, p in zip(texts, plain, strict=True) if p], add_special_tokens=False))
        others = iter(self.library.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [next(lowered if p else others) for p in plain]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each with the space before it."""
        out: list[bytes] = []
        runs = [words[i : i + RUN] for i in range(0, len(words), RUN)]
        for run, e in zip(runs, self._runs(runs), strict=True):
            ids = np.asarray(e.ids, dtype="<u4")
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(run):
                out += self._whole(list(map(_placed, run)))
                continue
            cuts = [0, *(4 * edges + 4).tolist()] if self.drops_space else [*(4 * edges).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _learn(self, words: list[str], marked: list[tuple[str, str]], others: list[str]) -> None:
        """Remembers the ids of pieces; a word with marks at its end is put together from the two."""
        known = self.inner.young
        words = list({*words, *self.inner.missing({b for _, b in marked}, turn=False)})
        known.update(zip(words, self._words(words), strict=True))
        known.update(zip(others, self._whole(list(map(_placed, others))), strict=True))
        self._open({p[len(base) :] for p, base in marked})
        for p, base in marked:
            known[p] = known[base] + self.opening[p[len(base) :]]

    def _open(self, pieces: set[str]) -> None:
        """Remembers the ids of pieces with nothing before them."""
        new = list(pieces.difference(self.opening))
        self.opening.update(zip(new, self._whole(new), strict=True))

    def _pieces(self, text: str) -> list[str]:
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ") if self.drops_space else text.replace("\n", " \n")
        return (text if _APART.search(text) else text.replace(". ", f" {_STOP} ")).split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._pieces(t) for t in texts]
        # Where the space before it counts, the first piece has none.
        first = [] if self.drops_space else [p.pop(0) for p in cut]
        known = self.inner.turn()
        known[_STOP] = self.stop
        found = [list(map(known.get, p)) for p in cut]
        holes = [[i for i, x in enumerate(f) if x is None] for f in found]
        words, marked, others = _kinds(self.inner.missing({p[i] for p, h in zip(cut, holes, strict=True) for i in h}, turn=False))
        beside: list[int] = []
        if not self.drops_space:
            # A text has neighbouring white space if one of its pieces shows it; these are never learned, so only new ones can.
            shown = {p for p in (*others, *first) if _beside(p)}
            if shown:
                beside = [k for k, (p, h) in enumerate(zip(cut, holes, strict=True)) if first[k] in shown or any(p[i] in shown for i in h)]
                for k in beside:
                    found[k], holes[k] = [], []
                asked = {p[i] for p, h in zip(cut, holes, strict=True) for i in h}
                words, marked, others = [p for p in words if p in asked], [x for x in marked if x[0] in asked], [p for p in others if p in asked]
        if len(self.opening) > CACHE_PIECES:
            self.opening.clear()
        self._learn(words, marked, others)
        for p, f, h in zip(cut, found, holes, strict=True):
            for i in h:
                f[i] = known[p[i]]
        out = [b"".join(f) for f in found]
        if first:
            self._open(set(first).difference(shown))
            out = [self.opening.get(p, b"") + x for p, x in zip(first, out, strict=True)]
        for k, x in zip(beside, self._whole([texts[k] for k in beside]), strict=True):
            out[k] = x
        return out


def _kinds(pieces: list[str]) -> tuple[list[str], list[tuple[str, str]], list[str]]:
    """Words of letters, words with marks at their end (and without them), and other pieces."""
    words, marked, others = [], [], []
    for p in pieces:
        base = p if p.isalpha() else p.rstrip(_MARKS)
        if p[:1] == "\n" and p[1:].isascii() and p[1:].isalpha():
            words.append(p)
            continue
        if not (base.isalpha() and (base.isascii() or normalize("NFC", base).lower().isalpha())):  # some letters are more when composed or lower-cased
            others.append(p)
        elif len(base) == len(p):
            words.append(p)
        else:
            marked.append((p, base))
    return words, marked, others


def _placed(piece: str) -> str:
    """The piece with what stands before it."""
    return piece if piece[:1] == "\n" or not piece else " " + piece


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _beside(piece: str) -> bool:
    return not piece or piece[-1].isspace() or (piece[0] != "\n" and piece[0].isspace()) or _NEIGHBOURS.search(piece) is not None


@lru_cache(maxsize=4)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One per worker process, vocabulary and reading of special tokens."""
    return Encoder(path, special_as_text)
