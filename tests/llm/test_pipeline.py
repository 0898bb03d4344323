import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lobwright.llm import queries
from odd_tables import documents
from test_quality_and_pii import failed, quality_rows, secret_rows
from test_similarity import ITEMS, fingerprint, group_rows, leak_rows

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check_queries import TABLES, canon  # noqa: E402

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    rel = con.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(rel.fetchall(), names)


def test_all_eleven_are_registered():
    names = {n.split("_")[0] for n in entry.queries()}
    assert {f"op{k}" for k in range(1, 11)} | {"pipeline"} <= names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "personal_data", "packing"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1).write.parquet(path + "/benchmark.parquet")
    rows = quality_rows() + group_rows() + secret_rows() + leak_rows()
    long_enough = [(10_000 + k, f"{t} " + " ".join(f"p{k}x{j}" for j in range(60))) for k, (_, t) in enumerate(secret_rows())]
    leaks = [(20_000 + k, " ".join(f"q{k}x{j}" for j in range(60)) + " " + ITEMS[k % 2][1]) for k in range(20)]
    documents(spark, rows + long_enough + leaks).coalesce(2).write.parquet(path + "/documents.parquet")
    return path


def test_stages_do_what_they_decide(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    stage, columns = dict(corpus_pipeline.STAGES), docs.columns
    good = stage["quality_rules"](spark, docs, folder)
    rows = good.collect()
    assert good.columns == columns and rows and len(rows) == sum(failed(r["text"]) == 0 for r in docs.collect())
    single = stage["simhash_near_dedup"](spark, good, folder)
    kept = single.collect()
    prints = [fingerprint(r["text"]) for r in kept]
    assert single.columns == columns and 0 < len(kept) < len(rows)
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
    clean = stage["benchmark_decontamination"](spark, single, folder)
    left = clean.collect()
    assert clean.columns == columns and len(left) <= len(kept) - 20 and all(r["doc_id"] < 20_000 for r in left if r["doc_id"]) and not any(ITEMS[0][1] in r["text"] for r in left)
    assert {r["doc_id"] for r in kept if "geese" not in r["text"].lower() and "coins" not in r["text"]} == {r["doc_id"] for r in left if "geese" not in r["text"].lower()}
    private = stage["personal_data"](spark, clean, folder)
    assert private.columns == columns and private.count() == len(left) and private.where("text like '%[SECRET]%'").count() >= 30
    pieces = stage["packing"](spark, private, folder)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in left}


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(out.columns)


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(folder + "/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(folder + "/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nothing_else_imports_the_package():
    found = subprocess.run(["grep", "-rln", "lobwright.llm\\|corpus_pipeline", ROOT, "--include=*.py"], capture_output=True, text=True).stdout.split()
    outside = {os.path.relpath(f, ROOT) for f in found if "/llm/" not in f}
    assert outside <= {"__spark_entry__.py", "corpus_pipeline.py"}
