import hashlib
import math

import numpy as np
import pytest

from lobwright.llm.vector_codes import decode, encode, fit_codebooks, kept_vectors, largest, nearest, vector_codes


def brute(rows, parts=16, entries=64, rounds=2):
    """Every entry compared, in Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = [(i, [v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)], lab) for i, v, lab in kept]
    books = [[c[p] for _, c, _ in sorted(cut, key=lambda x: (x[0], x[1]))[:entries]] for p in range(parts)]
    find = lambda part, book: min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, c, _ in cut:
                groups.setdefault(find(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    found = [(i, [find(c[p], books[p]) for p in range(parts)], lab) for i, c, lab in cut]
    label = {}
    for _, best, lab in found:
        label[lab] = label.get(lab, 0) + sum(d for d, _ in best)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label[lab], sha) for i, best, lab in found)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, i, i) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, row long, n long")


def made(count=150, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).round(2).tolist(), int(rng.integers(3))) for i in range(count)]
    return rows + [(1, rows[-1][1], None), (2, rows[2][1], None), (900, [0.0] * dim, 1), (901, [-0.001] * dim, 1)]


def odd(dim=32):
    return [(2000, None, 1), (2001, [None] + [0.0] * (dim - 1), 1), (2002, [math.nan] + [0.0] * (dim - 1), 0), (2003, [-math.inf] * dim, 0)]


@pytest.mark.parametrize("count", [3, 40, 300])
def test_as_brute_force(spark, count):
    rows = made(count)
    assert sorted(tuple(r) for r in vector_codes(frame(spark, rows + odd())).collect()) == brute(rows)


def test_labels_too_many_to_broadcast(spark, monkeypatch):
    from lobwright.llm import vector_codes as module

    monkeypatch.setattr(module, "bounded", lambda df, name: df)
    rows = made(60)
    assert sorted(tuple(r) for r in vector_codes(frame(spark, rows)).collect()) == brute(rows)


def test_nearest_with_ties():
    rng = np.random.default_rng(2)
    for dim in (1, 2, 4, 7):
        entries, parts = rng.integers(-4, 5, (40, dim)), rng.integers(-6, 7, (3000, dim))
        index, away = nearest(parts, entries)
        every = ((parts[:, None] - entries) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (away == every.min(axis=1)).all()


def test_largest_numbers_stay_exact():
    for dim in (1, 4, 64, 100, 1000):
        top = largest(dim)
        entries = np.array([[top] * dim, [-top] * dim, [0] * dim])
        index, away = nearest(np.array([[-top] * dim, [top - 1] * dim]), entries)
        assert index.tolist() == [1, 0] and away.tolist() == [0, dim]
        assert dim * 4 * top * top * dim < 1 << 63


def test_vectors_that_cannot_be_encoded(spark):
    rows = made(30)
    strange = [(-3, [], 7), (-2, [1.0] * 31, 7), (-1, [1e30] * 32, 7), (400, [1.0] * 48, 7)]
    got = sorted(tuple(r)[:4] for r in vector_codes(frame(spark, rows + strange)).collect())
    want = [x[:4] for x in brute(rows)] + [(i, None, None, None) for i, _, _ in strange]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_nothing_to_encode(spark):
    assert vector_codes(frame(spark, [])).count() == 0
    got = vector_codes(frame(spark, [(None, [], None), (1, [], 2)])).collect()
    assert sorted((r.vec_id is None, r.code, r.error, r.label_error) for r in got) == [(False, None, None, None), (True, None, None, None)]


def test_decoded_vectors_are_entries(spark):
    kept = kept_vectors(frame(spark, made(100)), "embedding")
    books = fit_codebooks(kept, "vec_id", "embedding", parts=8, entries=20)
    back = decode(encode(kept, "embedding", books).select("row.vec_id", "code", "error"), "code", books).collect()
    vectors = {r.vec_id: r.embedding for r in kept.collect() if r.vec_id > 10}
    for r in back:
        if r.vec_id > 10:
            steps = np.floor(np.array(vectors[r.vec_id]) * 256) - np.array(r.decoded) * 256
            assert (steps**2).sum() == r.error
