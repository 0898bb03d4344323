"""URL filter lists.

Each URL is expanded into expressions: every suffix of its host, joined with every prefix of its path that is as long as
some rule's path.  The SHA-256 digests of the expressions meet the rules' on their first 32 bits, an equi-join; the full
digests then confirm, and of the rules that fit the longest decides.

Null or malformed URLs have an empty host and path and fit no rule.  Rows are kept one for one: repeated rows, null ids
and further columns do no harm (only ``page_id`` and ``url`` are read).  Of two rules of equal length the one with the
longer host wins, then ``block`` before ``allow``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobwright.llm.common import bounded, let, lower_ascii

#: Hex digits of a digest on which URLs and rules are joined.
PREFIX_DIGITS = 8

#: What a URL gets that fits no rule.
DEFAULT_VERDICT = "allow"


def url_host(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` gives ``a.b.c``, ``b.c`` and ``c``; an empty host gives none."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        let(F.split(host, r"\."), lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digests and rank; of equal rules the blocking one stays."""
    return rules.where("host is not null and path is not null and verdict is not null").groupBy(
        lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")
    ).agg(F.max("verdict").alias("rule_verdict")).withColumn("digest", F.sha2(F.concat("rule_host", "rule_path"), 256)).select(
        F.substring("digest", 1, PREFIX_DIGITS).alias("prefix"), "digest",
        F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
            F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule"),
        ).alias("found"), F.length("rule_path").alias("path_size"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url).

    ``rules`` has host, path and verdict (``allow`` or ``block``).  The rules are counted before they are broadcast; a
    list beyond the limit is joined by a shuffle on the digest prefix.  Rows are grouped by (page_id, url) first, so a
    URL that fills the table is expanded as often as its pages have ids, and no group is gathered in one task.
    """
    ranked = bounded(rule_table(rules), name="url_rules")
    rows = pages.groupBy("page_id", "url").agg(F.count("*").alias("n"))
    lengths = [r[0] for r in ranked.select("path_size").distinct().orderBy("path_size").limit(10_001).collect()]
    path = url_path(F.col("url"))
    # Few distinct lengths: only prefixes of these; otherwise prefixes of every length.
    cuts = F.array(*[F.lit(n) for n in lengths]) if 0 < len(lengths) <= 10_000 else F.sequence(F.lit(0), F.length(path))
    expressions = let(path, lambda p: F.flatten(F.transform(
        host_suffixes(url_host(F.col("url"))),
        lambda h: F.transform(F.filter(cuts, lambda n: n <= F.length(p)), lambda n: F.concat(h, F.substring(p, F.lit(1), n))))))
    expanded = rows.select("page_id", "url", F.explode(F.array_distinct(expressions)).alias("expression")).select(
        "page_id", "url", F.sha2("expression", 256).alias("own")).withColumn("prefix", F.substring("own", 1, PREFIX_DIGITS))
    best = expanded.join(ranked, "prefix").where("own = digest").groupBy("page_id", "url").agg(F.max("found").alias("found"))
    left, right = rows.alias("l"), best.alias("r")
    judged = left.join(right, F.col("l.page_id").eqNullSafe(F.col("r.page_id")) & F.col("l.url").eqNullSafe(F.col("r.url")), "left")
    return judged.select(
        F.col("l.page_id").alias("page_id"), url_host(F.col("l.url")).alias("host"), url_path(F.col("l.url")).alias("path"),
        F.col("r.found.rule").alias("rule"), F.coalesce("r.found.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("l.n"))).alias("copy")).drop("copy")
