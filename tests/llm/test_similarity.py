from collections import Counter
import random

import pytest
import xxhash

from lobwright.llm import simhash
from lobwright.llm.components import components
from lobwright.llm.decontaminate import contaminated_pairs, drop_contaminated
from lobwright.llm.license_scan import TEMPLATES, scan_licenses
from lobwright.llm.simhash import keep_one_of_each_group, simhash_groups
from odd_tables import PROSE, documents, odd_rows, tokens, words


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def roots(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def group_rows():
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    near = []
    for k in range(60):
        w = list(base)
        w[rng.randrange(400)] = f"x{k}"
        near.append((100 + k, " ".join(w)))
    return odd_rows() + near + [(300 + k, " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(80))) for k in range(40)]


@pytest.mark.parametrize("bucket", [100, 1])
def test_groups_as_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rows = group_rows()
    prints = [fingerprint(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    top = roots(range(len(rows)), linked)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top[i]] = min(least.get(top[i], d), d)
    want = Counter((d, f"{prints[i]:016x}", least.get(top[i])) for i, (d, _) in enumerate(rows))
    assert Counter(tuple(r) for r in simhash_groups(documents(spark, rows, extra=True)).collect()) == want
    assert len(linked) > 100


def test_one_of_each_group_stays(spark):
    rows = group_rows()
    docs = documents(spark, rows, extra=True)
    kept = keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    prints = {t: fingerprint(t) for _, t in rows}
    top = roots(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[rows[i][1]] ^ prints[rows[j][1]]).bit_count() <= 2])
    assert kept.count() == len(set(top.values()))
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got[1] == 1 and got[2] == 0 and all(got[300 + k] == 1 for k in range(40))
    assert keep_one_of_each_group(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    rng = random.Random(4)
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in chain + star + [(5000, 5000)]]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + k: 1000 for k in range(300)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEMS = [
    (1, "Seven grey geese flew over the frozen lake before sunrise while the miller counted his sacks of barley and oats."),
    (2, "What is the smallest number of coins that a clerk needs for every price below one crown?"), (3, None), (4, "too short"), (5, ""),
]


def leak_rows():
    one = ITEMS[0][1]
    swapped = " ".join("zzz" if k % 6 == 3 else w for k, w in enumerate(one.split()))
    return odd_rows() + [(70, PROSE + " " + one + " " + PROSE), (71, "Before. " + swapped.upper() + " After."), (72, one[: len(one) // 3]),
                         (73, "\n".join(ITEMS[1][1].split())), (74, (one + " ") * 3), (75, " ".join(reversed(one.split())))] + [(80 + k, f"{k} {one}") for k in range(300)]


def benchmark(spark):
    return spark.createDataFrame([(i, t, i) for i, t in ITEMS], "item_id long, text string, hash long")


def test_leaks(spark):
    rows = leak_rows()
    docs = documents(spark, rows, extra=True)
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated_pairs(docs, benchmark(spark)).collect()}
    assert set(got) == {(70, 1), (71, 1), (73, 2), (74, 1)} | {(80 + k, 1) for k in range(300)}
    exact = got[70, 1]
    n = len(tokens(ITEMS[0][1]))
    assert (exact["start"], exact["length"], exact["matched"], exact["item_tokens"]) == (len(tokens(PROSE)), n, n, n)
    equal = [1 if k % 6 != 3 else -3 for k in range(n)]
    best = max(sum(equal[a:b]) for a in range(n) for b in range(a + 1, n + 1))
    swapped = got[71, 1]
    assert swapped["matched"] - 3 * (swapped["length"] - swapped["matched"]) == best and got[74, 1]["start"] == 0
    kept = drop_contaminated(docs, benchmark(spark))
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in rows if (i, 1) not in got and (i, 2) not in got)
    assert contaminated_pairs(docs.limit(0), benchmark(spark)).count() == 0 and contaminated_pairs(docs, benchmark(spark).limit(0)).count() == 0


def license_rows():
    mit = TEMPLATES["MIT"]
    commented = "\n".join("# " + mit[i : i + 60] for i in range(0, len(mit), 60)).replace("# ", "\n * ")
    w = mit.split()
    return odd_rows() + [(80, PROSE + "\nReleased under the MIT License.\n" + PROSE), (81, PROSE + mit), (82, " ".join(w[: len(w) // 2])),
                         (83, " ".join("zzz" if k == 30 else x for k, x in enumerate(w))), (84, "licensed UNDER the apache license version 2 0"),
                         (85, TEMPLATES["BSD"] + " " + TEMPLATES["GPL-3.0"]), (86, (PROSE + " ") * 20 + commented)]


def test_licenses_as_brute_force(spark):
    rows = license_rows()
    sets = lambda t: {tuple(x[i : i + 5]) for x in [tokens(t)] for i in range(len(x) - 4)}
    want = set()
    for i, t in rows:
        for name, template in TEMPLATES.items():
            wanted = sets(template)
            if len(wanted & sets(t)) >= 0.8 * len(wanted):
                want.add((i, name))
    templates = spark.createDataFrame([*TEMPLATES.items(), ("none", None), ("short", "a b c")], "template string, text string")
    got = scan_licenses(documents(spark, rows, extra=True), templates).collect()
    assert {(r["doc_id"], r["template"]) for r in got} == want and len(got) == len(want) and (81, "MIT") in want
    for r in got:
        inside = tokens(dict(rows)[r["doc_id"]])[r["start"] : r["start"] + r["words"]]
        wanted = sets(TEMPLATES[r["template"]])
        assert len(wanted & sets(" ".join(inside))) == r["found"] and len(wanted) == r["wanted"]
    assert scan_licenses(documents(spark, []), templates).count() == 0
