import glob
from collections import Counter, defaultdict
import random
import zlib

import numpy as np
import public_tokenizers
from pyarrow import orc
import pytest
from tokenizers import Tokenizer

from lobwright.llm import packing
from lobwright.llm.packing import best_cuts, pack_documents, possible_cuts
from lobwright.llm.token_store import lookup, read_tokens, token_digest, write_tokens
from lobwright.llm.tokens import Encoder
from lobwright.sources.stages import new_path
from odd_tables import documents, odd_rows

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library_ids(path, texts):
    library = Tokenizer.from_file(path)
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_library_ids(path):
    rng, signs = random.Random(1), "ab'sé İß19.,!?#\n\t\r   ́ﬁ😀中\x1c -"
    signs = [*signs, "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(5000)] + [t or "" for _, t in odd_rows()]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path).encode(texts)] == library_ids(path, texts)


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr("lobwright.llm.tokens.CACHE_PIECES", 3)
    e = Encoder(BYTES)
    texts = ["a b c d e", "a b, c. d", "f g a b"]
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == library_ids(BYTES, texts)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_generations_turn_between_batches_only(path, monkeypatch):
    """A batch that finds the memory full still reads what it asked for, words with marks among it."""
    monkeypatch.setattr("lobwright.llm.tokens.CACHE_PIECES", 40)
    e, rng = Encoder(path), random.Random(6)
    names = ["".join(rng.choice("abcdeno") for _ in range(rng.randint(1, 5))) for _ in range(120)]
    for _ in range(60):
        texts = [" ".join(rng.choice(names) + rng.choice(["", "", ".", ",", "!?"]) for _ in range(rng.randint(0, 30))) for _ in range(8)]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == library_ids(path, texts)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_a_word_before_a_full_stop_is_learned_once(path):
    e = Encoder(path)
    texts = ["a mote. mote. Mote mote", "b mote. mote. x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == library_ids(path, texts)
    assert "mote." not in e.inner.young


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_marks_after_anything(path):
    before = ["", "a", "7", "\u00bd", "\u4e2d", "e\u0301", "\u0301", "_", ".", ",", "!", "%%", "'s", " ", "\n", "\t", "<|endoftext|>", "\u0130", "\u0958", "x\ufb2a", "\u03a3", "\u01c4", "\u0391\u03a3", "\u212b", "\U0001f600", "\x1c", "\u00a0"]
    texts = [f"{x}{m}{y}" for x in before for m in (". ", ", ", ".", ",\n", " .\n") for y in ("", "b", ". c", ", \u00c9D", "\n")]
    texts += ["o " + t + " p" for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path).encode(texts)] == library_ids(path, texts)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_of_many_letters(path):
    rng = random.Random(3)
    letters = [chr(i) for i in range(0x41, 0x600) if chr(i).isalpha()]
    texts = [" ".join("".join(rng.choice(letters[: rng.choice([52, 114, len(letters)])]) for _ in range(rng.randint(1, 6))) for _ in range(300)) for _ in range(20)]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path).encode(texts)] == library_ids(path, texts)


@pytest.fixture(scope="module")
def stored(spark):
    path = new_path(spark, "tokens")
    write_tokens(documents(spark, extra=True).repartition(3), path, BYTES, 2)
    return path


def test_stored_tokens(spark, stored):
    rows = odd_rows()
    ids = {t: x + [2] for (_, t), x in zip(rows, library_ids(BYTES, [t for _, t in rows]), strict=True)}
    out = sorted(token_digest(spark, stored).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == Counter(
        (i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in rows)
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in out]
    assert order == sorted(order)


def test_lookup_and_file_format(spark, stored):
    got = lookup(spark, stored, [7, 8])
    assert sorted(r["doc_id"] for r in got.collect()) == [7, 8]
    assert "PushedFilters: [In(doc_id" in got._jdf.queryExecution().executedPlan().toString()
    files = glob.glob(stored + "/*.orc")
    assert sum(orc.ORCFile(f).nrows for f in files) == len(odd_rows())
    assert {(orc.ORCFile(f).row_index_stride, orc.ORCFile(f).compression) for f in files} == {(1000, "ZSTD")}
    ids = {r["doc_id"]: r["ids"] for r in read_tokens(spark, stored).where("doc_id in (7, 8)").collect()}
    assert ids[7] == library_ids(BYTES, ["word"])[0] + [2]


def test_empty_store(spark):
    path = new_path(spark, "tokens")
    write_tokens(documents(spark, []), path, BYTES, 2)
    assert token_digest(spark, path).count() == 0


def padding(size, window):
    return 0 if size & (size - 1) == 0 else window - size


def test_cuts_are_the_best(monkeypatch):
    monkeypatch.setattr(packing, "STEP", 8)
    rng, window = random.Random(5), 64
    for _ in range(30):
        ids = np.array([rng.randint(0, 20) for _ in range(rng.randint(1, 400))], dtype=np.uint32)
        ends = np.array(sorted({len(ids), *[rng.randint(1, len(ids)) for _ in range(4)]}))
        places, prices = possible_cuts(ids, ends, np.array([3], dtype=np.uint32), window)
        assert places[-1] == len(ids) and max(np.diff(places, prepend=0)) <= window
        inside = set(places.tolist()) - set(ends.tolist()) - set((np.flatnonzero(ids == 3) + 1).tolist())
        assert not inside or max(np.diff(sorted({0, *ends.tolist(), *(np.flatnonzero(ids == 3) + 1).tolist()}))) > window
        cost = {0: 0}
        for p, q in zip(places.tolist(), prices.tolist(), strict=True):
            short = lambda n: padding(n, window) if n >= 8 else window - n
            cost[p] = min(c + short(p - i) for i, c in cost.items() if p - i <= window) + q + packing.SEQUENCE
        cuts = best_cuts(places, prices, window, True)
        price = dict(zip(places.tolist(), prices.tolist(), strict=True))
        got = sum((padding(b - a, window) if b - a >= 8 else window - b + a) + price[b] + packing.SEQUENCE for a, b in zip([0, *cuts], cuts, strict=False))
        assert got == cost[len(ids)]


@pytest.mark.parametrize("chunk", [3000, 1 << 19])
def test_pieces_cover_every_id(spark, chunk, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    rows = odd_rows()
    ids = {t: np.array(x + [1], "<u4") for (_, t), x in zip(rows, library_ids(WORDS, [t for _, t in rows]), strict=True)}
    pack = packing._pack(WORDS, 1, 2048, True)
    out = pack_documents(documents(spark, extra=True).coalesce(1), WORDS, 1, with_ids=True).collect() if chunk > 3000 else None
    if out is None:  # the chunk size is a constant of the worker, so small chunks run here
        import pyarrow as pa

        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        batch = pa.RecordBatch.from_pydict({"part": [0] * len(rows), "doc_id": [i for i, _ in ordered], "text": [t or "" for _, t in ordered]})
        out = [r for b in pack(iter([batch])) for r in b.to_pylist()]
    covered, sequences = Counter(), defaultdict(list)
    of = defaultdict(list)
    for i, t in rows:
        of[i].append(ids[t])
    for r in out:
        piece = np.array(r["ids"], "<u4")
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and len(piece) == r["length"]
        assert any(len(x) == r["doc_tokens"] and (x[r["start"] : r["start"] + r["length"]] == piece).all() for x in of[r["doc_id"]] if len(x) >= r["start"] + r["length"])
        covered[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == Counter({i: sum(map(len, x)) for i, x in of.items()})
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    sizes = [sum(n for _, n in p) for p in sequences.values()]
    assert sum(padding(s, 2048) for s in sizes) < 0.02 * sum(sizes) + 4096


def test_nothing_to_pack(spark):
    assert pack_documents(documents(spark, []), WORDS, 1).count() == 0


def test_white_space_is_looked_at_once_a_piece(monkeypatch):
    """Texts with neighbouring white space are told by their distinct pieces, not by reading every text again."""
    from lobwright.llm import tokens

    seen, beside = [], tokens._beside
    monkeypatch.setattr(tokens, "_beside", lambda p: seen.append(p) or beside(p))
    texts = ["a, b\nc, d"] * 50 + ["a,  b", "a,\n b", " a, b", "a, b\t", "a,\tb", "\x1c", ""]
    for _ in range(2):
        e = Encoder(BYTES) if not seen else e
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == library_ids(BYTES, texts)
    assert len(seen) < 150 and seen.count("\nc,") == 1
