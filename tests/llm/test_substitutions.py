from itertools import combinations
from math import ceil

import pytest

from lobwright.llm.decontaminate import LEAST, MASKS, SHARE, SPAN, contaminated_pairs
from odd_tables import documents


def best_stretch(equal):
    """(matched, length, first) by trying every stretch of which three quarters are equal."""
    spans = [(sum(equal[a:b]), a - b, -a) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if 4 * sum(equal[a:b]) >= 3 * (b - a)]
    matched, less, at = max(spans)
    return matched, -less, -at


@pytest.mark.parametrize(("n", "unseen"), [(13, 0), (16, 2), (20, 0)])
def test_one_to_three_substitutions_at_every_position(spark, n, unseen):
    places = [c for k in (1, 2, 3) for c in combinations(range(n), k)]
    docs = documents(spark, [(i, "before " + " ".join(f"x{j}" if j in c else f"t{j}" for j in range(n)) + " after") for i, c in enumerate(places)])
    item = spark.createDataFrame([(1, " ".join(f"t{j}" for j in range(n)))], "item_id long, text string")
    want, no_seed = {}, 0
    for i, c in enumerate(places):
        equal = [j not in c for j in range(n)]
        matched, length, first = best_stretch(equal)
        if matched >= min(LEAST, ceil(SHARE * n)):
            if any(all(equal[at + q] for q in mask) for mask in MASKS for at in range(n - SPAN + 1)):
                want[i] = (first + 1, length, matched, n)
            else:
                no_seed += 1
    got = {r["doc_id"]: (r["start"], r["length"], r["matched"], r["item_tokens"]) for r in contaminated_pairs(docs, item).collect()}
    assert got == want and no_seed == unseen
