from collections import Counter
import random
import re

import pytest

from lobwright.llm.collocations import collocations
from odd_tables import CLASHING, PROSE, documents, long_text, odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000, absorb=100):
    """Every phrase counted by itself, every cut scored with Python's integers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    often = {key: c for key, c in f.items() if c >= least}
    gone = {(lang, p[i:j]) for (lang, p), c in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
            if j - i < len(p) and 100 * c >= absorb * f[lang, p[i:j]]}
    found = []
    for (lang, p), a in often.items():
        if len(p) > 1 and (lang, p) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted((lang, rank, *x[1:]) for lang in n for rank, x in enumerate(
        sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top], 1))


def invented(seed=3):
    random.seed(seed)
    names = ["a", "b", "B", "c", "dé", "日本", "x1", "I", "#"]
    text = lambda: "".join(random.choice(names) + random.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "; ", "\x0b"]) for _ in range(300))
    return [(random.choice(["en", "en", "de", None]), text()) for _ in range(40)] + [("en", None), ("en", ""), ("fr", " .\n"), ("es", "x " * 5000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


@pytest.mark.parametrize("options", [{}, {"words": 0}, {"pairs": 0}, {"absorb": 60, "top": 7}])
def test_as_brute_force(spark, options):
    rows = invented()
    limits = {k: v for k, v in options.items() if k in ("absorb", "top")}
    got = sorted(tuple(r) for r in collocations(frame(spark, rows), least=12, **options).collect())
    assert got == brute(rows, 12, **limits)
    assert any(r[0] == "und" for r in got) and any(len(r[2].split()) == 5 for r in got)


def test_given_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert sorted(tuple(r) for r in collocations(docs, least=8).collect()) == brute(rows, 8)


def test_odd_rows_and_columns(spark):
    rows = odd_rows() + [(20, PROSE)] * 100 + [(21, long_text(60_000))]
    assert set(CLASHING)
    got = sorted(tuple(r) for r in collocations(documents(spark, rows, extra=True)).collect())
    assert got == brute([("en", t) for _, t in rows], 100) and got


@pytest.mark.parametrize("words", [0, 10])
def test_nothing_to_count(spark, words):
    assert collocations(documents(spark, []), words=words).count() == 0
    assert collocations(documents(spark, [(1, None), (2, "only once")]), words=words).count() == 0


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from lobwright.llm.collocations import _score

    a, n, l, r = 10**12 + 7, 3 * 10**14 + 1, 10**12 + 9, 10**13 + 3
    got = spark.range(1).select(_score(*[F.lit(x).cast("long") for x in (a, n, l, r)])).first()[0]
    assert got == 1000 * a * n // (l * r)


def test_combining_holds_little():
    """Windows that hardly repeat: what a task holds is bounded by a few blocks, not by the text it has read."""
    import numpy as np
    import pyarrow as pa

    from lobwright.llm.collocations import _combined

    read = []
    tables = (read.append(k) or pa.table({"pair": np.arange(k * 250_000, k * 250_000 + 300_000)}) for k in range(16))
    out = _combined(tables, ["pair"])
    first = next(out)
    assert len(read) <= 4
    assert sum(first.column("n").to_pylist()) + sum(sum(b.column("n").to_pylist()) for b in out) == 16 * 300_000
