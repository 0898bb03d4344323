"""Personal data in texts: exact base kinds, and secrets found by weak supervision.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches of fixed patterns with a check on digits.  Secrets
(keys, tokens, passwords) have no such pattern: every long run of letters and digits is a candidate, and four labelers vote
on it: its shape (regex), a name like ``token`` or ``password`` before it (gazetteer), an assignment before it (context) and
the spread of its characters.  Nobody labels candidates by hand.  Expectation-maximisation estimates each labeler's
reliability from how votes agree over all documents, and so the probability that a candidate with given votes is a secret;
with these probabilities as soft labels, a final classifier learns weights for features of the span, and decides.

All of it is column expressions.  Counts of vote patterns and of feature values, at most some hundred rows whatever the
size of the corpus, are all that reaches the driver.

Offsets are code points, ends exclusive.  Null and empty texts have no spans; repeated rows are judged alike, row by row;
without candidates nothing is trained and base spans remain; an empty table gives no rows; further columns pass through
``redact_documents`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobwright.llm.common import let
from lobwright.sources.stages import cut

#: Base patterns.  The lookbehinds and possessive marks only spare attempts that would fail: a match starts
#: where a run of its first characters starts, or where the match before ended.
_RUN = r"(?:\G|(?<![{0}]))[{0}]"
PATTERNS = {
    "email": _RUN.format("A-Za-z0-9._%+-") + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _RUN.format("0-9") + r"++(?:\.[0-9]++){3}",
    "card": _RUN.format("0-9") + r"(?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = _RUN.format("A-Za-z0-9_") + r"{20,}+"

#: Names of secrets, the gazetteer.
NAMES = "token secret password passwd pwd apikey api_key api-key key auth bearer credential credentials access".split()

#: Characters before a candidate that its labelers see.
CONTEXT = 32

#: Matches whose offsets are summed up together; keeps the work on a text with very many matches near linear.
BLOCK = 256


def _running(numbers: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """Array of ``fold`` (a sum, a maximum) over the first 1, 2, ... numbers, beginning with 0."""
    none, long0 = F.array().cast("array<bigint>"), F.lit(0).cast("long")
    inside = lambda part, base: F.aggregate(
        part, F.struct(base.alias("s"), none.alias("out")),
        lambda a, x: F.struct(fold(a["s"], x).alias("s"), F.array_append(a["out"], fold(a["s"], x)).alias("out")))
    blocks = F.transform(F.sequence(F.lit(1), F.size(numbers), F.lit(BLOCK)), lambda k: F.slice(numbers, k, BLOCK))
    empty = F.array().cast("array<array<bigint>>")
    whole = F.aggregate(
        blocks, F.struct(long0.alias("s"), empty.alias("parts")),
        lambda a, b: let(inside(b, a["s"]), lambda i: F.struct(i["s"].alias("s"), F.array_append(a["parts"], i["out"]).alias("parts"))))
    return F.flatten(whole["parts"])


SPAN = "array<struct<start:bigint,end:bigint,match:string,before:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, match, before)."""
    def placed(found: Column, between: Column) -> Column:
        sizes = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(between, i))).cast("long"))
        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(let(_running(sizes, lambda a, x: a + x), lambda ends: F.transform(found, lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"),
            F.right(F.get(between, i), F.lit(CONTEXT)).alias("before")))))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: let(F.split(text, pattern, -1), lambda between: placed(found, between)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def point(turned: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return let(F.reverse(digits), lambda t: F.aggregate(
        F.sequence(F.lit(1), F.length(t)), F.lit(0), lambda s, i: s + point(t, i))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    if kind == "ip":
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, the valid matches.  A text without the kind's own signs is not searched."""
    none = F.array().cast(SPAN)
    signs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    valid = lambda kind: lambda m: _valid(kind, m["match"])
    return {k: F.when(signs[k], F.filter(matches(text, p), valid(k))).otherwise(none) for k, p in PATTERNS.items()}


def candidates(text: Column) -> Column:
    """Runs of 20 characters or more with letters and digits, as (start, end, votes, features)."""
    names = "(?i)(?:^|[^A-Za-z])(?:" + "|".join(NAMES) + r")[^A-Za-z0-9]*$"

    def judged(c: Column) -> Column:
        m, before = c["match"], c["before"]
        share = F.length(_digits(m)) / F.length(m)
        kinds = F.size(F.array_distinct(F.split(m, "")))
        votes = (
            F.when(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") | share.between(0.1, 0.7), 1).otherwise(-1),
            F.when(before.rlike(names), 1).otherwise(0),
            F.when(before.rlike("[=:]\\s*[\"']?$"), 1).otherwise(-1),
            F.when(kinds >= 8, 1).otherwise(-1),
        )
        code = F.lit(0)
        for v in votes:
            code = code * 3 + v + 1
        features = F.array(
            F.least(F.length(m) / 8, F.lit(9)).cast("int"), F.floor(share * 10).cast("int"), F.least(kinds / 3, F.lit(9)).cast("int"),
            F.when(m.rlike("^[0-9a-f]+$"), 1).otherwise(0), F.when(before.rlike(names), 1).otherwise(0),
            F.when(before.rlike("[\"']$"), 1).otherwise(0), F.when(before.rlike("[=:]"), 1).otherwise(0))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), code.cast("int").alias("votes"), features.alias("features"))

    kind = "array<struct<start:bigint,end:bigint,votes:int,features:array<int>>>"
    mixed = lambda c: c["match"].rlike("[0-9]") & c["match"].rlike("[A-Za-z]")
    return F.when(text.rlike("[A-Za-z0-9_]{20}"), F.transform(F.filter(matches(text, SECRET), mixed), judged)).otherwise(F.array().cast(kind))


LABELERS, FEATURES = 4, 7


def estimate(counts: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """Probability of a secret for each vote pattern, by expectation-maximisation over the labelers' reliabilities.

    Each labeler has for either truth a distribution over its three votes; votes are independent given the truth.  The
    first guess is the majority.
    """
    votes = {c: [(c // 3 ** (LABELERS - 1 - k)) % 3 for k in range(LABELERS)] for c in counts}
    sure = {c: 0.9 if sum(v) > LABELERS else 0.1 if sum(v) < LABELERS else 0.5 for c, v in votes.items()}
    for _ in range(rounds):
        total = sum(counts.values())
        yes = sum(counts[c] * p for c, p in sure.items())
        prior = (yes + 1) / (total + 2)
        table = [[[1.0] * 3 for _ in range(LABELERS)] for _ in range(2)]
        for c, p in sure.items():
            for k, v in enumerate(votes[c]):
                table[1][k][v] += counts[c] * p
                table[0][k][v] += counts[c] * (1 - p)
        for side, k in product(range(2), range(LABELERS)):
            whole = sum(table[side][k])
            table[side][k] = [x / whole for x in table[side][k]]
        for c, v in votes.items():
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[1][k][x] / table[0][k][x]) for k, x in enumerate(v))
            sure[c] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return sure


def train(found: DataFrame) -> tuple[float, dict[tuple[int, int], float]] | None:
    """Bias and weights by (feature, value), from the ``candidates`` column of all rows; None without candidates."""
    each = found.select(F.explode("candidates").alias("c")).select("c.votes", "c.features")
    counts = {r[0]: r[1] for r in each.groupBy("votes").count().collect()}  # 3 ** LABELERS rows at most
    if not counts:
        return None
    sure = estimate(counts)
    soft = F.create_map(*[x for c, p in sure.items() for x in (F.lit(c), F.lit(p))])[F.col("votes")]
    sums = each.select(soft.alias("p"), F.posexplode("features").alias("feature", "value")).groupBy("feature", "value").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # FEATURES times ten rows at most
    yes, no = (sum(r[k] for r in sums if r["feature"] == 0) for k in ("yes", "no"))
    weights = {(r["feature"], r["value"]): math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2)) for r in sums}
    return math.log((yes + 1) / (no + 1)), weights


def accepted(found: Column, model: tuple[float, dict[tuple[int, int], float]] | None) -> Column:
    """The candidates that the classifier calls secrets, as (start, end)."""
    if model is None:
        return F.array().cast("array<struct<start:bigint,end:bigint>>")
    bias, weights = model
    table = F.create_map(*[x for (f, v), w in sorted(weights.items()) for x in (F.lit(100 * f + v), F.lit(w))])
    score = lambda c: F.aggregate(
        F.transform(c["features"], lambda v, i: F.coalesce(F.try_element_at(table, 100 * i + v), F.lit(0.0))), F.lit(bias), lambda a, w: a + w)
    return F.transform(F.filter(found, lambda c: score(c) > 0), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))


def search(docs: DataFrame) -> DataFrame:
    """(doc_id, one column of spans for each base kind, candidates): narrow rows, one for each of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    short = lambda a: F.transform(a, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return docs.select("doc_id", *[short(c).alias(k) for k, c in base_spans(text).items()], candidates(text).alias("candidates"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret) of each of ``docs`` (doc_id, text).

    The texts are read once, without a shuffle; training and the verdicts work on the narrow rows written from them.
    """
    found = cut(search(docs), "pii_spans")
    kinds = [*PATTERNS, "secret"]
    names = lambda k: F.transform(k, lambda s: F.concat(F.lit(f"{k}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    marked = found.withColumn("secret", accepted(F.col("candidates"), train(found)))
    base = F.concat(*[names(k) for k in PATTERNS])
    return marked.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[names(k) for k in kinds]), ",").alias("spans"), F.size("secret").cast("long").alias("n_secret"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span, given as (start, end, kind), replaced by its kind in brackets; overlaps become one."""
    def apart(ordered: Column) -> Column:
        def merged(reach: Column) -> Column:
            opens = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i)["start"] >= F.get(reach, i - 1)))
            return let(opens, lambda o: F.transform(o, lambda i, j: F.struct(
                F.get(ordered, i)["start"].alias("start"), F.get(reach, F.coalesce(F.get(o, j + 1), F.size(ordered)) - 1).alias("end"),
                F.get(ordered, i)["kind"].alias("kind"))))

        return let(_running(F.transform(ordered, lambda s: s["end"]), F.greatest), merged)

    def joined(kept: Column, letters: Column) -> Column:
        ahead = F.transform(kept, lambda s, i: F.concat(
            F.array_join(F.slice(letters, F.coalesce(F.get(kept, i - 1)["end"], F.lit(0)).cast("int") + 1,
                                 (s["start"] - F.coalesce(F.get(kept, i - 1)["end"], F.lit(0))).cast("int")), ""), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        last = F.element_at(kept, -1)["end"].cast("int")
        return F.concat(F.array_join(ahead, ""), F.array_join(F.slice(letters, last + 1, F.greatest(F.size(letters) - last, F.lit(0))), ""))

    return F.when(F.size(spans) == 0, text).otherwise(let(let(F.sort_array(spans), apart), lambda kept: let(F.split(text, ""), lambda letters: joined(kept, letters))))


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind; ``n_chars``, where there is one, follows.  All rows stay."""
    model = train(cut(docs.select(candidates(F.coalesce("text", F.lit(""))).alias("candidates")).where(F.size("candidates") > 0), "pii_candidates"))
    text = F.col("text")
    tagged = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    spans = F.concat(*[tagged(c, k) for k, c in base_spans(text).items()], tagged(accepted(candidates(text), model), "secret"))
    clean = docs.withColumn("text", F.when(text.isNotNull(), let(spans, lambda s: redact(text, s))))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
