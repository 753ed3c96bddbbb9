"""Ancestor tests by intervals against plain walks over random trees."""

import random

import pytest
from pyspark.sql import functions as F

from hushframe.operators import intervals, nodes
from hushframe.sources import pages as source


def made_trees(pages=6, n=60, seed=5):
    rng, rows = random.Random(seed), []
    for page in range(pages):
        parents, last = [None], {}
        for i in range(1, n):
            up = i - 1
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                up = parents[up] if parents[up] is not None else up
            parents.append(up)
        for i in reversed(range(n)):
            last[i] = max(last.get(i, i), i)
            if parents[i] is not None:
                last[parents[i]] = max(last.get(parents[i], 0), last[i])
        above = lambda i: [] if parents[i] is None else [parents[i], *above(parents[i])]  # noqa: E731, B023
        rows += [(page, i, last[i], above(i), rng.random() < 0.3, rng.choice("abc"), rng.random() < 0.5) for i in range(n)]
    return rows


@pytest.fixture(scope="module")
def trees():
    return made_trees()


@pytest.fixture(scope="module")
def rows(spark, trees):
    shape = "page_id long, node_id int, last int, ancestors array<int>, marked boolean, name string, strong boolean"
    return spark.createDataFrame(trees, shape).drop("ancestors").repartition(5, "strong").cache()


def test_within_and_holds(rows, trees):
    marked = {(t[0], t[1]) for t in trees if t[4]}
    got = {(r["page_id"], r["node_id"]): (r["w"], r["h"]) for r in rows.select("page_id", "node_id", intervals.within(F.col("marked")).alias("w"), intervals.holds(F.col("marked")).alias("h")).collect()}
    above = {(t[0], t[1]): {(t[0], a) for a in t[3]} for t in trees}
    below = {(p, a) for (p, n), ups in above.items() if (p, n) in marked for _, a in ups}
    assert got == {k: (bool(ups & marked), k in below) for k, ups in above.items()}


def test_innermost(rows, trees):
    marked = {(t[0], t[1]): t[5] for t in trees if t[4]}
    out = intervals.innermost(rows, F.col("marked"), "level", outer=F.col("node_id"), called=F.col("name"))
    assert out.columns == [*rows.columns, "level", "outer", "called"]
    for r in out.collect():
        ups = next(t[3] for t in trees if (t[0], t[1]) == (r["page_id"], r["node_id"]))
        chain = [a for a in ups if (r["page_id"], a) in marked]
        assert (r["level"], r["outer"], r["called"]) == (len(chain), chain[0] if chain else None, marked[r["page_id"], chain[0]] if chain else None)
    assert out.count() == len(trees)


def test_dominance(rows, trees):
    kept = {(r["page_id"], r["node_id"]) for r in nodes.name_dominance(rows).collect()}
    by = {(t[0], t[1]): t for t in trees}
    gone = {k for k, t in by.items() if any(by[t[0], a][5] == t[5] and (by[t[0], a][6] or not t[6]) for a in t[3])}
    assert kept == set(by) - gone


def test_one_exchange_serves_all(spark):
    rows = spark.range(10).selectExpr("id % 2 as page_id", "cast(id as int) as node_id", "cast(id as int) as last", "id % 3 = 0 as marked")
    marked = intervals.marked_by(rows.select("page_id", "node_id", "last"), rows.where("marked").select("page_id", "node_id"), "marked")
    out = intervals.innermost(marked.withColumns({"w": intervals.within(F.col("marked")), "h": intervals.holds(F.col("marked"))}), F.col("marked"), "level", outer=F.col("node_id"))
    plan = out.groupBy("page_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_deep_pages_end_where_they_began(spark):
    html = "<div>" * 3000 + "<a href=/x>deep</a>" + "</div>" * 1500 + "<nav><button>other</button></nav>"
    got = nodes.placed_controls(source.page_nodes(spark.createDataFrame([(1, "", html), (2, "", None), (3, "", "")], "page_id long, url string, html string"))).orderBy("node_id").collect()
    assert [(r["tag"], r["element"], r["level"], r["parent"], r["name"]) for r in got] == [("a", True, 0, None, "deep"), ("nav", False, 0, None, None), ("button", True, 1, 3001, "other")]
    assert got[1]["depth"] == 1500
