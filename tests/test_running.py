"""Running sums within groups of any size, and handles numbered by them."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hushframe.functions.running import running_sum
from hushframe.operators import vault


@pytest.mark.parametrize("shape", ["one", "many", "mixed", "none"])
def test_against_plain_sums(spark, shape):
    rng = random.Random(3)
    names = {"one": ["a"], "many": [f"g{i}" for i in range(300)], "mixed": ["big"] * 700 + ["x", "y", None], "none": []}[shape]
    rows = [(rng.choice(names), i, rng.randrange(-3, 9)) for i in range(2000)] if names else []
    rng.shuffle(rows)
    got = running_sum(spark.createDataFrame(rows, "g string, at int, w long").repartition(3), "g", ["at"], "w", "n").collect()
    sums, want = {}, []
    for g, at, w in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + w
        want.append((g, at, w, sums[g]))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_one_scope_of_many_values(spark):
    """As a window gives it, without a task that has much more than its share."""
    n = 200_000
    found = spark.range(n).selectExpr("'s' as scope", "'email' as kind", "concat('user', (id * 7919) % 150001) as text", "id * 31 % 200003 as at", "cast(id % 5 as int) as start")
    got = vault.handle_numbering(found, "scope", ["at", "start"])
    shares = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(shares) <= 2 * sum(shares) / int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = found.groupBy("scope", "kind", F.col("text").alias("value")).agg(F.min(F.struct("at", "start")).alias("at"))
    want = first.select("scope", "kind", "value", F.row_number().over(Window.partitionBy("scope").orderBy("at", "kind", "value")).cast("long").alias("n"))
    assert got.drop("handle").exceptAll(want).isEmpty() and got.count() == want.count()


def test_counting_goes_on_for_every_scope(spark):
    entries = [(f"{s}", f"email#{k}", "email", f"v{k}", k, 1) for s in range(40) for k in range(1, s % 5 + 1)]
    known = spark.createDataFrame(entries, vault.SCHEMA)
    found = spark.createDataFrame([(s, t, 0, f"v{s % 5 + 2 - t}", "email") for s in range(40) for t in range(2)], "scope int, turn int, start int, text string, kind string")
    minted, seen = vault.newly_minted(found, known, "scope", ["turn", "start"], gen=2)
    assert seen.count() == 80
    have = {(s, v) for s, _, _, v, _, _ in entries}
    want = set()
    for s in range(40):
        n = s % 5
        for t in range(2):
            if (str(s), value := f"v{s % 5 + 2 - t}") not in have:
                n += 1
                want.add((str(s), value, n))
    assert {(r["scope"], r["value"], r["n"]) for r in minted.collect()} == want
