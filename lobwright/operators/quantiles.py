"""Exact linear-interpolation quantiles per group at any group size.

``percentile`` keeps every distinct value of a group in one task.  That is right for groups of a checked size.  Beyond it, order
statistics are found by counting: each value becomes a 64-bit code in the same order, and every pass counts the codes that share
a found prefix by their next ``BITS`` bits, which tells the prefix that holds the wanted rank.  After the last pass the prefix is
the value.  Only counts are shuffled, at most ``2 ** BITS`` of them for a group, column and prefix, and nothing is estimated, so
no pass can miss.  Both ways give the same numbers.

Missing values are left out, NaN counts as the largest number, both zeros are one.  A group of missing values only has missing
quantiles, null keys are a group of their own, an empty table gives no rows (one row of nulls if there are no keys).
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobwright.sources.stages import cut

#: ``percentile`` holds a boxed entry for each value of a group and column in one task: 250,000 rows of eight columns are about 200 MB.
EXACT_ROWS = 250_000

#: Bits of the code that one pass resolves.
BITS = 16
WIDTH = 64


def largest_group(df: DataFrame, keys: list[str]) -> int:
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")) if keys else df.agg(F.count("*").alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    wanted: dict[str, tuple[Column, float]],
    exact_rows: int = EXACT_ROWS,
    bits: int = BITS,
    largest: int | None = None,
) -> DataFrame:
    """One row per group with a column per ``name -> (expression, q)``; missing values are left out.

    ``largest`` is the size of the largest group when the caller knows it already.
    """
    columns = {}
    for name, (expr, q) in wanted.items():
        columns.setdefault(str(expr), (expr, []))[1].append((name, q))
    cols = {f"_v{i}": (expr, items) for i, (expr, items) in enumerate(columns.values())}
    slim = df.select(*keys, *[e.cast("double").alias(v) for v, (e, _) in cols.items()])
    if (largest if largest is not None else largest_group(df, keys)) <= exact_rows:
        aggs = [F.expr(f"percentile({v}, array({', '.join(f'{q}D' for _, q in items)})) as _p{v}") for v, (_, items) in cols.items()]
        packed = slim.groupBy(*keys).agg(*aggs) if keys else slim.agg(*aggs)
        return packed.selectExpr(*keys, *[f"_p{v}[{i}] as {n}" for v, (_, items) in cols.items() for i, (n, _) in enumerate(items)])
    return _counted(slim, keys, {v: items for v, (_, items) in cols.items()}, bits)


def bits_of(value: Column) -> Column:
    """The bits of a double as a long; both zeros have the same."""
    return F.when(value.isNotNull(), F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long"))


def double_of(bits: Column) -> Column:
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def turned(bits: Column) -> Column:
    """The bits of a double as a code that is ordered as the doubles are, and back: negative numbers have those below the sign turned."""
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def _counted(slim: DataFrame, keys: list[str], questions: dict[str, list[tuple[str, float]]], bits: int) -> DataFrame:
    # Inside a struct null keys meet each other in joins.  Its fields are named by place, so that a key may have any name.
    group = F.struct(F.lit(0).alias("_all"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).alias("_g")
    raw = slim.select(group, *[bits_of(F.col(v)).alias(v) for v in questions])
    coded = cut(raw.select("_g", *[turned(F.col(v)).alias(v) for v in questions]), "quantile_codes")
    each = coded.select("_g", F.posexplode(F.array(*questions)).alias("_c", "_code"))
    steps = [*range(bits, WIDTH, bits), WIDTH]

    def prefix(length: int) -> Column:
        return F.shiftright("_code", WIDTH - length)

    start = cut(each.groupBy("_g", "_c", prefix(steps[0]).alias("_prefix")).agg(F.count("*").alias("_k")), "quantile_counts")
    known = start.where("_prefix is not null").withColumn("_found", F.lit(0).cast("long"))
    levels = F.array(*[F.array(*[F.lit(float(q)) for q in sorted({q for _, q in items})]) for items in questions.values()])
    asked = known.groupBy("_g", "_c").agg(F.sum("_k").alias("_n")).withColumn("_q", F.explode(levels[F.col("_c")]))
    asked = asked.withColumn("_place", (F.col("_n") - 1) * F.col("_q"))
    ranks = asked.select("_g", "_c", F.explode(F.array(F.floor("_place"), F.ceil("_place"))).alias("_rank")).distinct()
    open_ = cut(_narrowed(known, ranks.withColumn("_found", F.lit(0).cast("long")).withColumn("_left", F.col("_rank"))), "quantile_ranks")
    for before, after in pairwise(steps):
        inside = each.withColumn("_found", prefix(before)).join(open_.select("_g", "_c", "_found").distinct(), ["_g", "_c", "_found"])
        counts = inside.groupBy("_g", "_c", "_found", prefix(after).alias("_prefix")).agg(F.count("*").alias("_k"))
        open_ = cut(_narrowed(counts, open_), "quantile_ranks")

    values = open_.withColumn("_value", double_of(turned(F.col("_found"))))
    held = values.groupBy("_g", "_c").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    low, high = F.col("_at")[F.floor("_place")], F.col("_at")[F.ceil("_place")]
    between = (F.ceil("_place") - F.col("_place")) * low + (F.col("_place") - F.floor("_place")) * high
    answers = asked.join(held, ["_g", "_c"]).withColumn("_value", F.when(low == high, low).otherwise(between))
    one = [F.max(F.when((F.col("_c") == c) & (F.col("_q") == q), F.col("_value"))).alias(name)
           for c, items in enumerate(questions.values()) for name, q in items]
    if not keys:
        return answers.groupBy().agg(*one)
    names = [name for items in questions.values() for name, _ in items]
    found = start.select("_g").distinct().join(answers.groupBy("_g").agg(*one), "_g", "left")
    return found.select(*[F.col("_g")[f"_k{i}"].alias(k) for i, k in enumerate(keys)], *names)


def _narrowed(counts: DataFrame, open_: DataFrame) -> DataFrame:
    """``open_`` (group, column, rank, found prefix, rank within it) with the longer prefix of ``counts`` that holds each rank."""
    order = Window.partitionBy("_g", "_c", "_found").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("_upto", F.sum("_k").over(order))
    holds = open_.join(upto, ["_g", "_c", "_found"]).where("_left < _upto and _left >= _upto - _k")
    return holds.select("_g", "_c", "_rank", F.col("_prefix").alias("_found"), (F.col("_left") - F.col("_upto") + F.col("_k")).alias("_left"))
