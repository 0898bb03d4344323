import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lobwright.llm.bpe import PairIndex, decode_ids, encode_texts, round_trip
from lobwright.llm.memory import Remembered
from odd_tables import documents, odd_rows

WORDS = public_tokenizers.path("word_bpe_49k.json")
FILES = [WORDS, public_tokenizers.path("byte_bpe_50k.json")]
LETTERS = " \t\n\r\x0b\x0c\x1c\x85\xa0　aaaabbabABÀéÉßİΣςñö́日本한한\U0001f469‍\U0001f469'sS'T're0123456789²Ⅷ.,;!?<|>-_\x00\x7f﻿​ͅǅﬁ"


def texts():
    rnd = random.Random(4)
    made = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    made += ["".join(rnd.choice("ab'slnotheri ") for _ in range(rnd.randint(0, 200))) for _ in range(500)]
    special = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|endoftext|><|endoftext|>a<|endof", "<|ENDOFTEXT|>", ""]
    return made + special + ["a" * 50_000, "ab" * 5000 + "é" * 3000, "word " * 50_000]


@pytest.mark.parametrize("path", FILES)
def test_ids_and_texts_are_the_library_s(path):
    library, index, all_texts = Tokenizer.from_file(path), PairIndex(path), texts()
    want = [e.ids for e in library.encode_batch(all_texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        got = index.encode([t.encode() for t in all_texts])
        assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == want
    assert [index.decode(g) for g in got] == library.decode_batch(want, skip_special_tokens=False)


def test_a_small_memory_changes_nothing():
    index, large = PairIndex(WORDS), PairIndex(WORDS)
    index.runs, index.pieces = Remembered(5), Remembered(3)
    parts = [t.encode() for t in texts()[:900]]
    assert [x for k in range(0, 900, 30) for x in index.encode(parts[k : k + 30])] == large.encode(parts)


def test_merges_beside_each_other():
    """Overlapping places of one pair are taken from the left; merged neighbours pair up again."""
    index = PairIndex(WORDS)
    library = Tokenizer.from_file(WORDS)
    for n in range(1, 40):
        for piece in ("a" * n, "ab" * n, "aab" * n, "the" * n):
            assert np.frombuffer(index.merged([piece, "x", piece])[0], dtype="<u4").tolist() == library.encode(piece, add_special_tokens=False).ids


def test_ids_outside_the_vocabulary_are_skipped():
    index, library = PairIndex(WORDS), Tokenizer.from_file(WORDS)
    ids = [10, 10**6, 49406, 320]
    assert index.decode(np.array(ids, dtype="<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_unsupported_files_are_an_error(tmp_path):
    import json

    spec = json.load(open(WORDS, encoding="utf-8"))
    spec["model"]["byte_fallback"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="plain byte-pair"):
        PairIndex(str(tmp_path / "other.json"))


def test_whole_tables(spark, sf):
    library = Tokenizer.from_file(WORDS)
    for docs in (documents(spark, odd_rows(), extra=True), spark.read.parquet(f"{sf}/documents.parquet"), documents(spark, [])):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        want = []
        for i, t in rows:
            ids = library.encode(t, add_special_tokens=False).ids
            sha = lambda x: hashlib.sha256(x).hexdigest()
            want.append((i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
        assert sorted(map(str, (tuple(r) for r in round_trip(docs, WORDS).collect()))) == sorted(map(str, want))


def test_other_columns_come_along(spark):
    docs = documents(spark, [(1, "One two"), (2, None)], extra=True)
    back = decode_ids(encode_texts(docs, WORDS), WORDS).select("row.row.*", "ids", "decoded").collect()
    assert {(r.doc_id, r.lang, r.candidates, r.decoded) for r in back} == {(1, "en", 1, "one</w> two</w>"), (2, "en", 2, "")}
