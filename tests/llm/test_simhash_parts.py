import random

import numpy as np

from lobwright.llm import near_dedup


def test_a_fingerprint_is_the_majority_of_the_hashes_of_its_part():
    rng = random.Random(1)
    for n in (1, 3, 7, 20, 146, 900, 5000):
        hashes = np.array(sorted({rng.getrandbits(64) for _ in range(n)}), dtype=np.uint64)
        log = max(1, (n // near_dedup.MEAN).bit_length() - 1)
        kept = min(1 << log, near_dedup.PARTS)
        want = {}
        for way in range(near_dedup.KEYS // kept):
            for h in hashes.tolist():
                part = ((h * int(near_dedup._TIMES[way, 0]) + int(near_dedup._PLUS[way, 0])) % (1 << 64)) >> (64 - log)
                if part < kept:
                    want.setdefault(way * kept + part, []).append(h)
        want = {k: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x) > len(x)) for k, x in want.items() if len(x) >= min(log, near_dedup.MEAN)}
        assert dict(zip(*(x.tolist() for x in near_dedup.part_prints(hashes, log)), strict=True)) == want


def test_pairs_at_the_limit_meet():
    """Sets of 4 to 1500 shingles at 0.8, by exchange and by addition, and unrelated ones."""
    rng, met, tried = np.random.default_rng(2), 0, 0
    fresh = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    keys = lambda x: set(near_dedup.print_keys(np.sort(x)))
    for n in (4, 5, 9, 11, 12, 23, 24, 46, 47, 60, 95, 96, 146, 191, 192, 383, 700, 1500):
        for _ in range(100):
            both = fresh(n)
            swapped, added = fresh(2 * (n // 9)), fresh(n // 4)
            e = n // 9
            a, b = np.concatenate([both[e:], swapped[:e]]), np.concatenate([both[e:], swapped[e:]])
            assert 10 * (n - e) >= 8 * (n + e) and not keys(a) & keys(fresh(n))
            met += bool(keys(a) & keys(b)) + bool(keys(both) & keys(np.concatenate([both, added])))
            tried += 2
    assert met >= tried - 3
