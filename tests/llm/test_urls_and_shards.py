from collections import Counter, defaultdict
import random
import zlib

from lobwright.llm.queries import URL_RULES
from lobwright.llm.sharding import communication_matrix, hypergeometric, shard_documents, shard_sizes, shuffle_into_shards
from lobwright.llm.url_rules import judge_urls
from odd_tables import documents, odd_rows

URLS = [
    "http://a.example.org/en/12", "https://EXAMPLE.org/en/1?q#f", "example.org/es/", "http://example.org", "http://x.com/fr/1", "http://x.com/de/2",
    "http://com/de/", "http://notexample.org/es/1", "ftp://a.b.c.d.example.org/es/x/y", "://", "", None, "http://x.com/de", "http://y.org?u=http://z.com/de/",
    "http:///de/", "http://x.com/FR/1", "http://x.com./fr/", "a\nb://q.com/de/z",
]


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls_as_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[4]), (None, None), (None, None)]
    pages = spark.createDataFrame([(i, u, i, i) for i, u in rows], "page_id long, url string, host long, found long")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = Counter(tuple(r) for r in judge_urls(pages, rules).collect())
    assert got == Counter((i, *brute(u, URL_RULES)) for i, u in rows)


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in judge_urls(pages, none).collect()] == [(1, "a.b", "/c", None, "allow")]
    assert judge_urls(pages.limit(0), none).count() == 0


def test_blocking_wins_among_equal_rules(spark):
    rules = spark.createDataFrame([("a.b", "/", "allow"), ("a.b", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.a.b/c")], "page_id long, url string")
    assert judge_urls(pages, rules).first()["verdict"] == "block"


def test_hypergeometric_draws():
    rng = random.Random(1)
    drawn = [hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    mean = sum(drawn) / len(drawn)
    spread = sum((x - mean) ** 2 for x in drawn) / len(drawn)
    assert abs(mean - 6) < 0.12 and abs(spread - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert hypergeometric(rng, 5, 0, 3) == 3 and hypergeometric(rng, 0, 5, 3) == 0 and hypergeometric(rng, 4, 2, 6) == 4
    assert 240_000 < hypergeometric(rng, 10**9, 3 * 10**9, 10**6) < 260_000


def test_matrix_sums():
    sources, shards = [7, 0, 1000, 13, 5], shard_sizes(1025, 40)
    matrix = communication_matrix(sources, shards, 3)
    assert [sum(r) for r in matrix] == sources and [sum(c) for c in zip(*matrix, strict=True)] == shards


def test_shards_are_exact(spark):
    rows = odd_rows() + [(100 + k, f"t{k % 7}") for k in range(500)]
    out = shard_documents(documents(spark, rows, extra=True).repartition(5), shards=40).collect()
    text = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len(text(t)) + 16, zlib.crc32(text(t))) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert sorted(map(len, slots.values())) == sorted(shard_sizes(len(rows), 40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}


def test_shuffle_is_uniform_and_repeatable(spark):
    df = spark.range(0, 8000, 1, 4)
    one = {r["id"]: (r["shard"], r["slot"]) for r in shuffle_into_shards(df, 8).collect()}
    assert one == {r["id"]: (r["shard"], r["slot"]) for r in shuffle_into_shards(df, 8).collect()}
    met = Counter((i // 1000, s) for i, (s, _) in one.items())  # 64 cells of 125 each
    assert sum((met[k, s] - 125) ** 2 / 125 for k in range(8) for s in range(8)) < 120
    places = Counter((i // 1000, p // 250) for i, (_, p) in one.items())  # 32 cells of 250
    assert sum((places[k, q] - 250) ** 2 / 250 for k in range(8) for q in range(4)) < 80


def test_empty_table(spark):
    assert shard_documents(documents(spark, []), 40).count() == 0
