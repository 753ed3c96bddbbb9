"""Overlaps by cells against all pairs, and what they cost on large groups."""

import random

import pytest
from pyspark.sql import functions as F

from hushframe.operators import boxes, cells, score

SIZES = [0.0, 0.5, 3.0, 16.0, 64.0, 65.0, 300.0, 5000.0]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(9)
    rows = [(g, i, rng.choice([rng.uniform(-900, 900), float(rng.randrange(-8, 8) * 16)]), rng.uniform(-900, 900), rng.choice(SIZES), rng.choice(SIZES)) for g in (1, 2, None) for i in range(120)]
    rows += [(1, 500, None, 0.0, 5.0, 5.0), (1, 501, 0.0, 0.0, -5.0, 5.0), (1, 502, float("nan"), 0.0, 5.0, 5.0), (1, 503, -1e300, -1e300, 2e300, 2e300), (1, 504, 1e17, 0.0, 3.0, 3.0), (1, 505, 1e17, 0.0, 3.0, 3.0)]
    return rows, spark.createDataFrame(rows, "g int, i int, x double, y double, w double, h double").cache()


def test_boxes_meet_as_all_pairs_do(made):
    rows, df = made
    got = [(r["g"], r["i"], r["b_i"]) for r in score.boxes_intersect(df, df, ["g"]).collect()]
    cross = lambda a, b, p: a[p] < b[p] + b[p + 2] and b[p] < a[p] + a[p + 2]
    sane = [r for r in rows if r[0] is not None and r[2] is not None and r[4] >= 0]
    want = [(a[0], a[1], b[1]) for a in sane for b in sane if a[0] == b[0] and cross(a, b, 2) and cross(a, b, 3)]
    assert sorted(got) == sorted(want)
    iou = boxes.box_iou(df, df, ["g"], below="i", apart=False).select("g", "i", "b_i", "iou")
    full = boxes.box_iou(df, df, ["g"], below="i").where("iou > 0").select("g", "i", "b_i", "iou")
    assert iou.where("iou > 0").exceptAll(full).isEmpty() and full.where("i not in (500, 501, 502) and b_i not in (500, 501, 502)").exceptAll(iou).isEmpty()


def test_touching_things_are_met_where_asked(spark):
    df = spark.createDataFrame([(1, "a", 0, 16), (1, "b", 16, 40), (1, "c", 17, 17), (2, "d", 0, 100)], "g int, i string, start int, end int")
    pairs = {(r["i"], r["b_i"]) for r in cells.meeting(df, df, ["g"], cells.span_axes(), cells.span_axes()).collect()}
    assert pairs == {("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}
    assert {(r["i"], r["b_i"]) for r in score.spans_intersect(df, df, ["g"]).collect()} == {("a", "a"), ("b", "b"), ("d", "d"), ("b", "c"), ("c", "b")}


def test_a_page_of_many_boxes(spark):
    n = 20_000
    page = spark.range(n).selectExpr("1L as page_id", "cast(id as int) as node_id", "cast(id as int) as last", "cast(id % 200 * 50 as double) as x", "cast(id div 200 * 40 as double) as y", "45.0D as w", "30.0D as h", "cast(id as int) as paint_order").cache()
    overlay = spark.range(40).selectExpr("1L as page_id", "cast(20000 + id as int) as node_id", "cast(20000 + id as int) as last", "0.0D as x", "cast(id * 100 as double) as y", "10000.0D as w", "20.0D as h", "cast(20000 + id as int) as paint_order")
    every = page.union(overlay)
    met = cells.meeting(every, every, ["page_id"], cells.box_axes(), cells.box_axes())
    assert met.count() < 6 * n + 40 * 40 * 200
    left = boxes.occlusion(page, every, 10000, 4000)
    # Bands from y = 100k to 100k + 20 cover the rows whose centres, 40j + 15, lie in them.
    hidden = sum(1 for j in range(100) if (40 * j + 15) % 100 <= 20) * 200
    assert left.count() == n - hidden


def test_a_text_of_many_spans(spark):
    found = spark.range(100_000).selectExpr("1 as page_id", "id * 10 as start", "id * 10 + 6 as end", "'email' as kind")
    truth = spark.range(50_000).selectExpr("1 as page_id", "id * 20 + 3 as start", "id * 20 + 8 as end", "if(id % 2 = 0, 'email', null) as kind", "if(id % 2 = 1, 'price', null) as decoy_reason")
    assert score.spans_intersect(truth, found, ["page_id"]).count() == 50_000
    one = score.score_detection(found, truth).first()
    assert (one["identifiers"], one["hit"], one["decoys"], one["decoys_covered"], one["precision_decoy"], one["precision_span"]) == (25_000, 25_000, 25_000, 25_000, 0.5, 0.25)


def test_score_table(spark):
    truth = spark.createDataFrame([(1, 0, 5, "email", None), (1, 0, 5, "email", None), (1, 10, 15, "tel", None), (1, 20, 25, None, "price"), (2, 0, 5, "pan", None)], "page_id int, start int, end int, kind string, decoy_reason string")
    found = spark.createDataFrame([(1, 4, 9, "email"), (1, 4, 9, "email"), (1, 24, 26, "tel"), (2, 5, 9, "pan")], "page_id int, start int, end int, kind string")
    got = {(r["kind"], r["total"]): tuple(r[c] for c in ("identifiers", "hit", "decoys", "decoys_covered", "shown", "right")) for r in score.score_table(found, truth).collect()}
    assert got == {("email", False): (2, 2, 0, 0, 1, 1), ("tel", False): (1, 0, 0, 0, 1, 0), ("pan", False): (1, 0, 0, 0, 1, 0), (None, False): (0, 0, 1, 1, 0, 0), (None, True): (4, 2, 1, 1, 3, 1)}
    assert {(r["kind"], r["hit"]) for r in score.score_by_kind(found, truth).collect()} == {("email", 2), ("tel", 0), ("pan", 0)}
    none = score.score_detection(found.limit(0), truth.limit(0)).first()
    assert none["identifiers"] == 0 and none["recall"] is None and none["precision_span"] is None
    assert score.score_table(found.limit(0), truth.limit(0)).where(F.col("identifiers") > 0).isEmpty()


def test_small_groups_meet_without_copies_and_large_ones_beside_them(spark):
    """A group's size on either side decides: one row against many goes by cells too."""
    few = spark.range(4000).selectExpr("id div 4 as g", "id as i", "cast(id % 4 * 40 as double) as x", "0.0D as y", "90.0D as w", "60.0D as h")
    pairs = score.boxes_intersect(few, few, ["g"])
    assert "explode" not in pairs._jdf.queryExecution().optimizedPlan().toString().lower()
    # Boxes at 0, 40, 80, 120, each 90 wide: neighbours and the next but one cross.
    assert pairs.count() == 1000 * (4 + 2 * 3 + 2 * 2)
    many = few.where("g = 7").selectExpr("g", "i as of").crossJoin(spark.range(100).selectExpr("id as i", "cast(id as double) as x", "0.0D as y", "1.0D as w", "1.0D as h")).where("of = 28").drop("of")
    mixed = few.union(many.select(*few.columns))
    met = score.boxes_intersect(few, mixed, ["g"])
    assert met.where("b_w = 90").exceptAll(pairs).isEmpty() and met.where("b_w = 90").count() == pairs.count()
    assert met.where("b_w = 1").count() == sum(1 for x in range(100) for at in (0, 40, 80, 120) if at - 1 < x < at + 90)
