"""The pipeline's stages, each against a plain version on its own input."""

import random

import pytest
from pyspark.sql import functions as F
from tests.llm import brute

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    item = words(30)
    rows = []
    for i in range(60):
        text = f"{words(120)}\n{'Shared footer line' if i % 2 else words(8)}\n{words(20)}"
        rows.append([i, text, "en", f"s{i % 3}"])
    rows += [[100 + i, rows[i][1], "en", "s1"] for i in range(5)]
    rows += [[200 + i, f"{words(60)} {item} {words(10)}", "en", "s2"] for i in range(3)]
    rows += [[300, "too short", "en", "s0"], [301, None, "en", None]]
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.orderBy("doc_id").collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert len(names) == 5
    before, found = docs, []
    for _, stage in corpus_pipeline.STAGES:
        found.append((before, stage(spark, before, folder).cache()))
        before = found[-1][1]
    (a, b), (c, d), (e, f), (g, h), (i, j) = found
    assert {r[0] for r in rows_of(b)} == {r[0] for r in brute.quality(rows_of(a)) if not r[6]}
    want = {r[0]: r[3] for r in brute.lines(rows_of(c))}
    assert {r[0]: brute.sha(r[1].encode()) for r in rows_of(d)} == want
    assert d.where(F.col("n_chars") != F.char_length("text")).count() == 0
    assert {r[0] for r in rows_of(f)} == {r[0] for r in brute.near_duplicates(rows_of(e)) if r[0] == r[2]}
    item = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    assert {r[0] for r in rows_of(h)} == {r[0] for r in brute.overlap(rows_of(g), [tuple(x) for x in item]) if not r[5]}
    assert not {200, 201, 202} & {r[0] for r in rows_of(h)}
    assert all(x.columns == columns for x in (b, d, f, h))
    assert {r["doc_id"] for r in j.collect()} <= {r[0] for r in rows_of(i)} and j.where("taken <= 0 or taken > 2 * size").isEmpty()
    run = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["taken"]) for r in run.collect()) == sorted((r["doc_id"], r["taken"]) for r in j.collect())


CLASHING = ("kept", "n_words", "spans", "n_lines", "contaminated", "taken", "size", "__w_key", "fingerprint", "a.b", "item_ids", "_keep")


@pytest.fixture(scope="module")
def clashing(spark, folder, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("clashing"))
    own = {c: F.concat(F.lit("own "), F.col("doc_id").cast("string")) for c in CLASHING}
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns(own).drop("n_chars")
    long = docs.limit(1).withColumns({"doc_id": F.lit(900).cast("long"), "text": F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.concat(F.lit("x"), i.cast("string"))))})
    docs.union(long.withColumns({c: F.lit("own 900") for c in CLASHING})).write.parquet(f"{where}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_columns_of_the_input_stay_as_they_are(spark, clashing):
    docs = spark.read.parquet(f"{clashing}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, clashing).cache()
        assert out.columns[: len(docs.columns)] == docs.columns, name
        rows = out.collect()
        assert 900 in {r["doc_id"] for r in rows}, name
        assert all(r[c] == f"own {r['doc_id']}" for r in rows for c in CLASHING), name
        docs = out.select(*[F.col(f"`{c}`") for c in docs.columns])
    assert {"mix_taken", "mix_size", "source_size", "target"} <= set(out.columns) and len({r["mix_taken"] for r in rows} - {0}) > 0


def test_nothing_in_nothing_out(spark, clashing):
    docs = spark.read.parquet(f"{clashing}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, clashing).count() == 0
