import random

from lobwright.llm import near_dedup
from odd_tables import documents
from test_near_dedup import brute


def test_members_just_outside_a_large_group_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Edits of one text, half of them too many to be linked: what is verified follows the members, not their pairs."""
    rng = random.Random(3)
    names = [f"w{k}" for k in range(4000)]
    base = [rng.choice(names) for _ in range(150)]
    texts = []
    for k in range(700):
        w = list(base)
        for at in rng.sample(range(150), k % 9):
            w[at] = rng.choice(names)
        texts.append(" ".join(w))
    pairs, verified = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda p, t: pairs.append(p.count()) or verified(p, t))
    kept = near_dedup.keep_one_of_each_group(documents(spark, list(enumerate(texts))))
    want = brute(texts)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert len(want) > 200 and sum(pairs) < 30 * len(texts)


def test_texts_that_share_only_rare_shingles(spark, monkeypatch):
    """Two edits of one text that are far from it and near each other are found through what only they hold."""
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    monkeypatch.setattr(near_dedup, "REPEATS", 0)
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    base = [word() for _ in range(150)]
    texts = [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(0, 150, 2)]
    for k in range(40):
        far = list(base)
        for at in rng.sample(range(150), 5):
            far[at] = word()
        texts += [" ".join(far), " ".join(far + [word()])]
    kept = near_dedup.keep_one_of_each_group(documents(spark, list(enumerate(texts))))
    want = brute(texts)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want) and len(want) > 20


def test_rare_shingles_take_one_shuffle(spark, monkeypatch):
    """Not a second one for a join as soon as they are too many to be broadcast."""
    monkeypatch.setattr(near_dedup, "RARE", 2)
    held = spark.createDataFrame([(1, 5), (1, 6), (2, 6), (1, 7), (2, 7), (3, 7)], "row long, shingle long")
    found = near_dedup.rare_shingles(held)
    assert sorted((r["row"], r["shingle"], r["holders"]) for r in found.collect()) == [(1, 5, 1), (1, 6, 2), (2, 6, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
