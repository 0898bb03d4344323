import random

import corpus_pipeline
from lobwright.llm import near_dedup
from odd_tables import documents


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def rows():
    """Edits of 1 to 20 words of texts of 60 to 400, a large group around one text, and texts with nothing in common."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    texts = []
    for _ in range(30):
        base = [word() for _ in range(rng.randint(60, 400))]
        for edits in (0, 0, 1, 2, 4, 8, 20):
            w = list(base)
            for at in rng.sample(range(len(w)), edits):
                w[at] = word()
            texts.append(" ".join(w))
    base = [word() for _ in range(300)]
    for k in range(150):
        w = list(base)
        for at in rng.sample(range(300), 1 + k % 9):
            w[at] = word()
        texts.append(" ".join(w).upper() if k % 2 else "  ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts))


def brute(texts):
    """The first of each group of texts, by comparing all that share a shingle."""
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and top(i) != top(j) and len(a & b) >= 0.8 * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {top(i) for i in range(len(texts))}


def test_near_copies_of_the_pipeline_as_brute_force(spark):
    found = rows()
    want = brute([t for _, t in found])
    docs = documents(spark, found, extra=True)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert 60 < len(want) < len(found) - 200


def test_a_large_group_that_drifts_apart(spark):
    """Copies of copies: neighbours are near, the ends have little in common, and a few stand just outside."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    line = [word() for _ in range(120)]
    texts = []
    for k in range(1200):
        if k % 3 == 0:
            line[rng.randrange(120)] = word()
        w = list(line)
        for at in rng.sample(range(120), k % 4):
            w[at] = word()
        texts.append(" ".join(w))
    texts += [" ".join([*t.split()[:80], *(word() for _ in range(40))]) for t in texts[::100]]
    found = list(enumerate(texts))
    kept = near_dedup.keep_one_of_each_group(documents(spark, found))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(brute(texts))


def test_long_texts_and_other_columns(spark):
    long = " ".join(f"v{i}" for i in range(200_000))
    found = [(1, long), (2, long + " end"), (3, long[: len(long) // 2]), (2, long)]
    kept = near_dedup.keep_one_of_each_group(documents(spark, found, extra=True))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_odd_rows(spark):
    odd = [(5, None), (4, ""), (3, " \n"), (None, "a b"), (None, "a  B"), (9, "one two three"), (8, "one two three four")]
    kept = near_dedup.keep_one_of_each_group(documents(spark, odd))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 8, 9, None]
    assert near_dedup.keep_one_of_each_group(kept.limit(0)).count() == 0
