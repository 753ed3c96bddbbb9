"""The vault's numbering and restoring, and the guard on request logs."""

import json

import pytest
from pyspark.sql import functions as F

from hushframe.operators import egress, identify, redact, vault
from hushframe.sources import tables
from hushframe.sources.vault_store import VaultStore

CHATS = [
    (1, 0, "user", "mail a@x.com and b@x.com"),
    (1, 1, "assistant", "again b@x.com, call 98765 43210"),
    (2, 0, "user", "only b@x.com"),
    (2, 1, "user", None),
]


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")


@pytest.fixture(scope="module")
def known(chats):
    found = identify.find_identifiers(chats, ["conv_id", "turn"], "text")
    return vault.handle_numbering(found, "conv_id", ["turn", "start"], tag="s").withColumn("seen_gen", F.lit(0).cast("long")).withColumnRenamed("conv_id", "scope")


def test_conversations_share_a_counter_over_kinds(chats):
    out = {(r["conv_id"], r["turn"]): r["text"] for r in vault.redact_conversations(chats).collect()}
    assert out[1, 0] == "mail [redacted:email#s1] and [redacted:email#s2]"
    assert out[1, 1] == "again [redacted:email#s2], call [redacted:tel#s3]"
    assert out[2, 0] == "only [redacted:email#s1]" and out[2, 1] is None


def test_session_handles_come_back_with_or_without_their_tag(spark, chats, known):
    hidden = vault.redact_conversations(chats)
    out = {(r["conv_id"], r["turn"]): r["text"] for r in vault.restore_session(hidden, ["conv_id", "turn"], "text", known, scope="conv_id").collect()}
    assert out == {(c, t): x for c, t, _, x in CHATS}
    loose = spark.createDataFrame([(1, "[redacted:email#1] [redacted:email#s9] [redacted:tel#3]")], "conv_id long, text string")
    row = vault.restore_session(loose, "conv_id", "text", known, scope="conv_id").first()
    assert row["text"] == "a@x.com [redacted:email#s9] 98765 43210" and row["kinds"] == ["email", "tel"]


def test_minting_keeps_handles_and_never_reuses_numbers(spark, chats):
    empty = spark.createDataFrame([], vault.SCHEMA)
    found = identify.find_identifiers(chats, ["conv_id", "turn"], "text")
    first = vault.vault_mint(found.where("turn = 0"), empty, "conv_id", ["turn", "start"], gen=1)
    second = vault.vault_mint(found, first, "conv_id", ["turn", "start"], gen=2)
    handles = {(r["scope"], r["value"]): (r["handle"], r["seen_gen"]) for r in second.collect()}
    assert handles == {("1", "a@x.com"): ("email#1", 2), ("1", "b@x.com"): ("email#2", 2), ("1", "98765 43210"): ("tel#3", 2), ("2", "b@x.com"): ("email#1", 2)}
    later = vault.vault_mint(spark.createDataFrame([(1, 9, 0, 5, "c@x.com", "email"), (1, 9, 6, 9, "a@x.com", "name")], "conv_id long, turn long, start int, end int, text string, kind string"), second, "conv_id", ["turn", "start"], gen=3)
    assert {r["handle"] for r in later.where("n > 3").collect()} == {"email#4", "name#5"}
    assert vault.vault_expiry(later, gen=4).count() == 2
    asked = spark.createDataFrame([("1", "email#2"), ("1", "email#99")], "scope string, handle string")
    assert [r["value"] for r in vault.vault_lookup(asked, later).collect()] == ["b@x.com"]


def test_rehydrate_refuses_other_kinds_stale_and_unknown_handles(spark):
    entries = [("p", "email#1", "email", "a$&b@x.com", 1, 5), ("p", "password#2", "password", "hunter2", 2, 5), ("p", "email#3", "email", "old@x.com", 3, 3)]
    known = spark.createDataFrame(entries, vault.SCHEMA)
    typed = [
        (1, "to [redacted:email#1] now", "email"), (2, "[redacted:password#2]", "email"), (3, "[redacted:password#2]", None),
        (4, "[redacted:email#3]", "email"), (5, "[redacted:email#9]", "email"), (6, "plain", None), (7, "[redacted:email#1] [redacted:email#1]", "email"),
    ]
    df = spark.createDataFrame([(*t, "p") for t in typed], "id int, text string, target string, scope string")
    out = {r["id"]: r for r in vault.rehydrate(df, "id", "text", "target", known, gen=5).collect()}
    assert out[1]["text"] == "to a$&b@x.com now" and out[1]["used"] == ["email"]
    assert out[7]["text"] == "a$&b@x.com a$&b@x.com" and out[6]["ok"]
    assert {i: out[i]["ok"] for i in (2, 3, 4, 5)} == dict.fromkeys((2, 3, 4, 5), False)
    assert out[2]["error"] == "password cannot go into email" and "stale" in out[4]["error"] and out[5]["text"] is None


def test_expected_kinds(spark):
    actions = spark.createDataFrame([(1, "email"), (2, "email"), (3, None)], "field int, expected_kind string")
    fields = spark.createDataFrame([(1, "email"), (2, None)], "field int, kind string")
    assert {r["field"]: r["ok"] for r in vault.expected_kind_check(actions, fields, ["field"]).collect()} == {1: True, 2: False, 3: True}


MAIL = "ravi@example.com"
REQUESTS = [
    # url, body, allowed, kinds
    ("https://api.example.com/v1", json.dumps({"role": "user"}), True, None),
    ("https://api.example.com/v1", json.dumps({"a": {"b": [MAIL]}}), False, ["email"]),
    ("https://api.example.com/v1", '{"a": "ravi\\u0040example.com"}', False, ["email"]),
    ("https://api.example.com/v1", json.dumps({"a": "x" * 200_000}), True, None),
    ("https://api.example.com/v1", "not JSON", False, None),
    ("https://api.example.com/v1", '{"a":1} trailing', False, None),
    ("https://api.example.com/v1", '{"a": NaN}', False, None),
    ("https://elsewhere.example.net/", "{}", False, None),
    ("https://api.example.com/v1", "", True, None),
    ("https://api.example.com/v1", None, True, None),
    ("data:text/plain,ravi@example.com", MAIL, True, None),
    ("no url at all", "{}", False, None),
    (None, "{}", False, None),
    ("https://api.example.com/v1", json.dumps({"a": "A" * 300}), True, None),
    ("https://api.example.com/v1", json.dumps({"n": 5555555555554444, MAIL: 1}), True, None),
    ("https://own.example.com/x", MAIL, True, None),
    ("https://api.example.com:8443/v1", "{}", False, None),
]


def test_verdicts(spark):
    rows = [(i, u, b) for i, (u, b, _, _) in enumerate(REQUESTS)]
    requests = spark.createDataFrame(rows, "request_id int, url string, body string").withColumn("at", F.timestamp_seconds("request_id"))
    hosts = spark.createDataFrame([("api.example.com",)], "host string")
    out = {r["request_id"]: r for r in egress.egress_verdict(requests, hosts, own_host="own.example.com").collect()}
    assert [out[i]["allowed"] for i in range(len(REQUESTS))] == [r[2] for r in REQUESTS]
    assert [out[i]["kinds"] for i in range(len(REQUESTS))] == [r[3] for r in REQUESTS]
    log = egress.egress_log(requests, hosts, own_host="own.example.com")
    assert log.count() == len(REQUESTS) - 2 and set(log.columns) == {"at", "host", "bytes", "allowed", "reason", "kinds"}
    one = egress.egress_summary(log).first()
    assert one["sent"] + one["refused"] == log.count()
    assert [r["at"] for r in egress.log_tail(log, 2).collect()] == sorted((r["at"] for r in log.collect()), reverse=True)[:2]


def test_sinks_leave_raw_values_out(spark, chats, tmp_path):
    out = redact.redact_drop(chats.withColumn("raw", F.col("text")), ["conv_id", "turn"], "text").withColumn("raw", F.lit("secret"))
    tables.sink_redacted(out, f"{tmp_path}/out", drop=["raw"])
    assert spark.read.parquet(f"{tmp_path}/out").columns == ["conv_id", "turn", "text", "kinds"]
    log = spark.createDataFrame([(1,)], "a int")
    tables.sink_egress_log(log, f"{tmp_path}/log")
    tables.sink_egress_log(log, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2


def test_the_stored_vault_grows_by_generations(spark, tmp_path, monkeypatch):
    rows = [(1, 0, 0, "a@x.com", "email"), (1, 0, 9, "b@x.com", "email"), (2, 0, 0, "b@x.com", "email"), (1, 1, 0, "c@x.com", "email"), (1, 1, 9, "a@x.com", "email"), (1, 2, 0, "c@x.com", "name")]
    found = spark.createDataFrame(rows, "conv_id long, turn long, start int, text string, kind string")
    where, order, mint = f"{tmp_path}/vault", ["turn", "start"], tables.sink_vault
    store = mint(found.where("turn = 0"), where, "conv_id", order, 1, buckets=8)
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "vault").rglob("part-*")}
    # A failure after the entries were written: the vault stays as it was, and the next attempt gives the same numbers.
    monkeypatch.setattr(VaultStore, "_complete", lambda self, gen: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        mint(found.where("turn = 1"), where, "conv_id", order, 2, buckets=8)
    monkeypatch.undo()
    rows_of = lambda s: sorted((r["scope"], r["handle"], r["value"], r["seen_gen"]) for r in s.vault().collect())
    assert rows_of(VaultStore(spark, where, 8)) == [("1", "email#1", "a@x.com", 1), ("1", "email#2", "b@x.com", 1), ("2", "email#1", "b@x.com", 1)]
    again = found.where("turn = 1").union(found.where("turn = 2"))
    for _ in range(2):  # done twice, it changes nothing more
        store = mint(again, where, "conv_id", order, 2, buckets=8)
        assert rows_of(store) == [("1", "email#1", "a@x.com", 2), ("1", "email#2", "b@x.com", 1), ("1", "email#3", "c@x.com", 2), ("1", "name#4", "c@x.com", 2), ("2", "email#1", "b@x.com", 1)]
    assert [tuple(r) for r in store.generations().orderBy("gen").collect()] == [(1, 3, 3), (2, 2, 3)]
    assert all(p.stat().st_mtime_ns == t for p, t in first.items())  # nothing is written again
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(store.vault())
    asked = found.select(F.col("conv_id").cast("string").alias("scope"), "kind", F.col("text").alias("value"))
    assert plan(asked.join(store._table("entries").hint("merge"), ["scope", "kind", "value"])).count("Exchange hashpartitioning") == 1
