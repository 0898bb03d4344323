"""Quality rules as a ledger of bits.

Every rule is evaluated once per document.  The ledger keeps the measurements and one integer whose bit k says that rule k
failed; a policy is a named mask of rules, so a new policy, or the question what each rule contributes, is a bitwise
operation over stored integers and never reads the texts again.

Null and blank texts have no words and fail the rule on length.  Repeated rows are judged alike, row by row; an empty table
gives no rows; only ``text`` is read, so further columns pass through whatever their names.  Window comparisons use 64-bit
hashes inside one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobwright.llm.common import let, words

#: The rules by bit.  Each takes the struct of measurements.
RULES = {
    "few_words": lambda m: m.n_words < 50,
    "repeated_words": lambda m: 100 * m.n_repeat_words > 50 * m.n_words,
    "many_symbols": lambda m: 10 * m.n_symbols > m.n_words,
    "duplicate_lines": lambda m: 2 * m.n_dup_lines > m.n_lines,
    "odd_word_length": lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 20 * m.n_words),
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}

#: Policies by version: the rules that reject a document.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": BIT["few_words"] | BIT["repeated_words"] | BIT["many_symbols"] | BIT["duplicate_lines"] | BIT["odd_word_length"],
}
CURRENT = "v1"


def repeated_word_count(found: Column, size: int = 3) -> Column:
    """How many words lie in a window of ``size`` words that the array holds twice or more."""
    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(
            (F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"]), F.get(s, k)["i"]))
        starts = F.sort_array(F.array_compact(let(order, twice)))
        width = lambda s: F.aggregate(
            F.transform(s, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(s, j + 1) - x, F.lit(size)))), F.lit(0), lambda a, b: a + b)
        # Most texts repeat no window; these need no sort.
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(starts, width))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(found) - size), lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(size)]))
    return F.when(F.size(found) <= size, 0).otherwise(let(hashes, covered)).cast("long")


def measure(text: Column) -> Column:
    """The struct of measurements of a text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))
    return let(words(whole), lambda w: let(lines, lambda x: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(x).cast("long").alias("n_lines"), repeated_word_count(w).alias("n_repeat_words"))))


def failed_bits(measured: Column) -> Column:
    """The integer whose bits are the failed rules."""
    bits = [F.when(rule(_Fields(measured)), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total


class _Fields:
    """``m.n_words`` for ``m["n_words"]``."""

    def __init__(self, struct: Column):
        self.struct = struct

    def __getattr__(self, name: str) -> Column:
        return self.struct[name]


def judged(text: Column) -> Column:
    """Struct of the measurements ``m`` and the ``failed`` bits."""
    return let(measure(text), lambda m: F.struct(m.alias("m"), failed_bits(m).alias("failed")))


def rule_ledger(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): measurements and ``failed_rules``.  No shuffle."""
    return docs.select("doc_id", judged(F.col("text")).alias("j")).select("doc_id", "j.m.*", F.col("j.failed").alias("failed_rules"))


def keep_documents(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule of the policy rejects."""
    return docs.where(judged(F.col("text"))["failed"].bitwiseAND(F.lit(POLICIES[policy])) == 0)


def quality_table(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with the verdicts of the base rules and of a policy, which includes the base rules."""
    hit = lambda name: F.col("failed_rules").bitwiseAND(F.lit(POLICIES[name])) != 0
    return rule_ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", hit("base").alias("base_failed"),
        (~(hit("base") | hit(policy))).alias("kept"), "failed_rules")


def ablations(ledger: DataFrame) -> DataFrame:
    """(policy, rule, failed, rejected, rejected_without): what each rule of each policy contributes.

    The ledger is first counted by its bits, at most 2 ** rules rows; all else is arithmetic on these.
    """
    spark = ledger.sparkSession
    counts = ledger.groupBy("failed_rules").agg(F.count("*").alias("n"))
    cases = F.broadcast(spark.createDataFrame(
        [(p, mask, r, BIT[r]) for p, mask in POLICIES.items() for r in RULES if mask & BIT[r]], "policy string, mask int, rule string, bit int"))
    some = lambda x: F.sum(F.when(x != 0, F.col("n")).otherwise(0))
    bits = F.col("failed_rules")
    every = counts.withColumn("all", F.lit(1)).join(cases.withColumn("all", F.lit(1)), "all")
    return every.groupBy("policy", "rule").agg(
        some(bits.bitwiseAND(F.col("bit"))).alias("failed"), some(bits.bitwiseAND(F.col("mask"))).alias("rejected"),
        some(bits.bitwiseAND(F.col("mask").bitwiseAND(F.bitwise_not("bit")))).alias("rejected_without"))
