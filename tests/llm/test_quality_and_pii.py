from collections import Counter
import hashlib
import random
import re

from pyspark.sql import functions as F

from lobwright.llm.pii import estimate, find_personal_data, redact_documents
from lobwright.llm.quality_rules import BIT, POLICIES, ablations, keep_documents, quality_table, rule_ledger
from odd_tables import documents, odd_rows, words

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def measures(text):
    w, text = words(text), text or ""
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(lines)


def failed(text):
    n, chars, symbols, dup, repeated, lines = measures(text)
    rules = (n < 50, 100 * repeated > 50 * n, 10 * symbols > n, 2 * dup > lines, chars < 2 * n or chars > 20 * n)
    return sum(1 << k for k, bad in enumerate(rules) if bad)


def quality_rows():
    return odd_rows() + [(50, "a b c a b c d a b c"), (51, "x y x y x y " * 30), (52, "a\na\n\nb\nb\nb"), (53, "| ".join(f"v{i}" for i in range(80))), (54, "a\x0bb\x0cc\rd e f")]


def test_quality_as_brute_force(spark):
    rows = quality_rows()
    got = Counter(tuple(r) for r in quality_table(documents(spark, rows, extra=True)).collect())
    want = Counter((i, *measures(t)[:5], failed(t) & 3 != 0, failed(t) == 0, failed(t)) for i, t in rows)
    assert got == want


def test_kept_documents_keep_their_columns(spark):
    rows = quality_rows()
    docs = documents(spark, rows, extra=True)
    kept = keep_documents(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((i, t) for i, t in rows if failed(t) == 0)
    assert keep_documents(docs.limit(0)).count() == 0


def test_ablations(spark):
    rows = quality_rows()
    got = {(r["policy"], r["rule"]): tuple(r)[2:] for r in ablations(rule_ledger(documents(spark, rows))).collect()}
    bits = [failed(t) for _, t in rows]
    for policy, mask in POLICIES.items():
        for rule, bit in BIT.items():
            if mask & bit:
                assert got[policy, rule] == (sum(b & bit > 0 for b in bits), sum(b & mask > 0 for b in bits), sum(b & mask & ~bit > 0 for b in bits))


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return {k: [m.span() for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in BASE.items()}


def pii_rows():
    rng, signs = random.Random(3), "ab1.2@-_ +()0é4555 999-.%"
    return odd_rows() + [(1000 + i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 300)))) for i in range(800)] + [
        (60, "1.2.3.4 " * 700), (61, "a" * 100_000), (62, "+1 (" * 5000), (63, "a." * 50_000 + "@x"), (64, "a@b.c_d@e.f 4111 1111 1111 1111 +1 (555) 123-4567 1.2.3.999 01.2.3.255")]


def secret_rows():
    rng = random.Random(9)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    return [(2000 + i, f'the place token = "{hexes()}" and more words') for i in range(40)] + [
        (3000 + i, "prose with averyveryverylongword" + "s" * 10 + str(i) + " in the middle") for i in range(40)]


def test_base_spans_as_brute_force(spark):
    rows = pii_rows()
    got = Counter(tuple(r)[:6] for r in find_personal_data(documents(spark, rows, extra=True)).collect())
    want = Counter()
    for i, t in rows:
        b = base(t)
        text = ",".join(f"{k}:{a}:{e}" for k in BASE for a, e in b[k])
        want[(i, *[len(b[k]) for k in BASE], hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want


def test_secrets_are_learned_without_labels(spark):
    rows = secret_rows()
    got = {r["doc_id"]: (r["n_secret"], r["spans"]) for r in find_personal_data(documents(spark, rows)).collect()}
    for i, t in rows:
        if i < 3000:
            at = t.index('"') + 1
            assert got[i] == (1, f"secret:{at}:{at + 40}")
        else:
            assert got[i] == (0, "")


def test_estimate_favours_agreeing_labelers():
    sure = estimate({80: 500, 1 + 3 * 0 + 9 + 27 * 0: 400, 0: 600})
    assert sure[80] > 0.99 and sure[0] < 0.01


def test_redaction(spark):
    rows = odd_rows() + secret_rows() + [(64, "é a@b.c_d@e.f 4111 1111 1111 1111, +1 (555) 123-4567 end"), (65, "1.2.3.4")]
    docs = documents(spark, rows, extra=True)
    out = redact_documents(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[64]["text"] == "é [EMAIL][EMAIL] [CARD], [PHONE] end" and got[65]["text"] == "[IP]" and got[4]["text"] is None
    assert got[2000]["text"] == 'the place token = "[SECRET]" and more words' and got[3000]["text"] == dict(rows)[3000]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())
    assert out.count() == len(rows) and redact_documents(docs.limit(0)).count() == 0
    assert find_personal_data(docs.where(F.lit(False))).count() == 0
