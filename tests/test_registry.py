"""Registered queries against their SQL, at the smallest scale; and that nothing needs the corpus operators."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hushframe.plans import registry

registry.load()
REPO = Path(__file__).parents[1]
TABLES = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{name}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, TABLES)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    assert got or name in ("detect_email_documents", "detect_card_documents")
    if name in registry.ORACLES:
        rows = duck.sql(registry.ORACLES[name])
        at = [rows.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in rows.fetchall()), key=repr)


def test_no_query_multiplies_tables(spark):
    for name in ("find_identifiers", "redact_conversations", "name_dominance", "score_detection", "vault_mint"):
        plan = registry.QUERIES[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    for part in ("hushframe", "__spark_entry__.py"):
        source = REPO / part
        subprocess.run(["cp", "-r", str(source), str(tmp_path)], check=True)
    if (tmp_path / "hushframe" / "llm").exists():
        (tmp_path / "hushframe" / "llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60; assert not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    if os.path.isdir(TABLES):
        code += f"; from pyspark.sql import SparkSession as S; assert q['detect_email'](S.builder.master('local[2]').getOrCreate(), '{TABLES}').count()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_texts_of_a_small_table_are_searched_on_all_cores(spark, tmp_path):
    """One row group is one task, and a filter on spans would work them out where the table is read, once more and before it is dealt."""
    spark.range(400).selectExpr("id as c_custkey", "cast(id % 25 as int) as c_nationkey", "'A' as c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = registry.QUERIES["find_identifiers"](spark, str(tmp_path))
    per_task = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("id").alias("n")).collect()
    assert len(per_task) >= 4 and max(r["n"] for r in per_task) < 200
    kinds = registry.QUERIES["identifier_kinds"](spark, str(tmp_path))
    plan = kinds._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "regexp" in line for line in plan.splitlines())
    assert kinds.count() == 400


def _agrees(spark, folder: str, name: str) -> None:
    """A query and its SQL over the tables in a folder."""
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    found = registry.QUERIES[name](spark, folder)
    rows = connection.sql(registry.ORACLES[name])
    at = [rows.columns.index(c) for c in found.columns]
    got = sorted(tuple(r) for r in found.collect())
    assert got and got == sorted(tuple(r[i] for i in at) for r in rows.fetchall())


@pytest.mark.parametrize("name", ["page_observation", "page_text_nodes"])
def test_pages_with_personal_titles_and_entities_without_their_end(spark, tmp_path, name):
    texts = ["Ends with a name&amp;&amp;&amp", "&lt;b&gt and &quot its &#39own &#39;&#39", "&amp;amp and &ampamp; and &copy 2024"]
    titles = ["Card 4111111111111111 of a.b@example.com", "Plain title", 'A "quoted" one']
    rows = [(i, f"https://x.example.com/{i}?m=u{i}@example.com", f"<html><head><title>{t}</title></head><body><p>{x}</p></body></html>") for i, (t, x) in enumerate(zip(titles, texts, strict=True))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    _agrees(spark, str(tmp_path), name)
