"""Registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lobwright.llm.bpe import round_trip
from lobwright.llm.collocations import collocations
from lobwright.llm.common import table
from lobwright.llm.decontaminate import contaminated_pairs
from lobwright.llm.html_density import extract_main_text
from lobwright.llm.license_scan import TEMPLATES, scan_licenses
from lobwright.llm.packing import pack_documents
from lobwright.llm.pii import find_personal_data
from lobwright.llm.quality_rules import quality_table
from lobwright.llm.sharding import shard_documents
from lobwright.llm.simhash import simhash_groups
from lobwright.llm.token_store import token_digest, write_tokens
from lobwright.llm.twins import COLLOCATIONS, vector_codes_sql
from lobwright.llm.url_rules import judge_urls
from lobwright.llm.vector_codes import vector_codes
from lobwright.sources.stages import new_path

#: The filter list of op9 as (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_digest(spark, path)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), spark.createDataFrame(list(TEMPLATES.items()), "template string, text string"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op4_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_license_scan": op2_license_scan,
    "op3_simhash": op3_simhash,
    "op4_html_density": op4_html_density,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontaminate": op8_decontaminate,
    "op9_url_rules": op9_url_rules,
    "op10_sharding": op10_sharding,
    "op11_collocations": op11_collocations,
    "op12_vector_codes": op12_vector_codes,
    "op13_bpe": op13_bpe,
}

#: Op9's twin: host and path by patterns, each rule tested against each URL, the longest that fits wins.
_OP9 = """
with rules(h, p, v) as (values {rules}),
u as (select page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') as raw,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
k as (select row_number() over () as k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u),
best as (select k, max(h || p) as rule, max_by(h || p, length(h || p)) as longest, max_by(v, length(h || p)) as v
         from k join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by k)
select page_id, host, path, longest as rule, coalesce(v, 'allow') as verdict from k left join best using (k)
""".format(rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES))

#: Op7's twin: windows as text, counted by a window function.
_OP7 = """
with t as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from t),
g as (select k, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) as gram from (select k, w, unnest(range(1, len(w) - 1)) as i from w)),
r as (select k, i from (select k, i, count(*) over (partition by k, gram) as n from g) where n > 1),
c as (select k, count(distinct i + d) as n_repeat_words from r, (values (0), (1), (2)) as o(d) group by k),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join c using (k)),
f as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
        + case when 10 * n_symbols > n_words then 4 else 0 end + case when 2 * n_dup_lines > n_lines then 8 else 0 end
        + case when word_chars < 2 * n_words or word_chars > 20 * n_words then 16 else 0 end)::int as failed_rules from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_rules & 3 <> 0 as base_failed,
  failed_rules = 0 as kept, failed_rules from f
"""

ORACLES: dict[str, str] = {
    "op7_quality_rules": _OP7,
    "op9_url_rules": _OP9,
    "op11_collocations": COLLOCATIONS,
    "op12_vector_codes": vector_codes_sql(),
}
