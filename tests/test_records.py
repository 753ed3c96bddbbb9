"""Boxes, chat logs and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hushframe.operators import boxes, chat, egress, identify, redact, vault
from hushframe.plans import registry
from hushframe.streaming import streams

registry.load()


def test_one_face_seen_by_two_strides_is_one(spark):
    det = [(1, 16, 5, 0.9, 0.9, [0.5, 0.5, 1.0, 1.0]), (1, 8, 13, 0.8, 0.9, [0.0, -0.0, 1.7, 1.7]), (1, 16, 300, 0.5, 0.49, [0.0, 0.0, 0.0, 0.0]), (2, 16, 0, 2.0, 1.5, [0.0, 0.0, 0.0, 0.0])]
    heads = spark.createDataFrame(det, "image_id long, stride int, i int, cls double, obj double, bbox array<double>")
    images = spark.createDataFrame([(1, 320, 1.0), (2, 320, 0.5)], "image_id long, columns int, ratio double")
    found = boxes.decode_anchors(heads, images)
    assert found.count() == 3 and found.where("image_id = 2").first()["score"] == 1.0
    kept = boxes.nms(found)
    assert sorted((r["image_id"], r["stride"]) for r in kept.collect()) in ([(1, 16), (2, 16)], [(1, 8), (1, 16), (2, 16)])
    same = found.where("image_id = 2").union(found.where("image_id = 2"))
    assert boxes.nms(same).count() == 1


def test_masks_are_clamped(spark):
    regions = spark.createDataFrame([(1, -10.0, 5.0, 20.0, 10.0), (1, 500.0, 5.0, 10.0, 10.0)], "image_id long, x double, y double, w double, h double")
    images = spark.createDataFrame([(1, 2.0, 100, 80)], "image_id long, factor double, width int, height int")
    assert [tuple(r) for r in boxes.mask_boxes(regions, images).collect()] == [(1, 0, 7, 23, 33)]


def test_occlusion(spark):
    shape = "page_id long, node_id int, last int, x double, y double, w double, h double, paint_order int"
    bounds = spark.createDataFrame([(1, 1, 2, 0.0, 0.0, 50.0, 50.0, 1), (1, 2, 2, 10.0, 10.0, 30.0, 30.0, 2), (1, 3, 3, 60.0, 0.0, 20.0, 20.0, 3), (1, 4, 4, 55.0, 0.0, 40.0, 40.0, 4), (1, 5, 5, 900.0, 0.0, 10.0, 10.0, 5)], shape)
    left = boxes.occlusion(bounds.select("page_id", "node_id", "last", "x", "y", "w", "h"), bounds, 200, 200)
    assert sorted(r["node_id"] for r in left.collect()) == [1, 2, 4, 5]


CHUNKS = [
    (1, 0, "call", 0, "a", "find", '{"q"', None), (1, 1, "call", 1, None, "open", "{", None), (1, 2, "call", 0, None, None, ': "x"}', None), (1, 3, "call", 1, None, None, "}", None),
    (1, 4, "content", None, None, None, "Hi ", None), (1, 5, "reasoning", None, None, None, "hm", None), (1, 6, "content", None, None, None, "you", "stop"), (2, 0, "call", 0, None, "go", None, None),
]
CHUNK_SCHEMA = "request_id int, seq int, channel string, idx int, id string, name string, args_fragment string, finish string"
CALLS = {(1, 0): ("a", "find", '{"q": "x"}'), (1, 1): ("call_1", "open", "{}")}


def test_fragments(spark):
    chunks = spark.createDataFrame(CHUNKS, CHUNK_SCHEMA)
    calls = {(r["request_id"], r["idx"]): (r["id"], r["name"], r["args"]) for r in chat.reassemble_calls(chunks).collect()}
    assert calls == CALLS | {(2, 0): ("call_0", "go", "")}
    one = chat.fold_reasoning(chunks).where("request_id = 1").first()
    assert (one["content"], one["reasoning"], one["n_calls"]) == ("Hi you", "hm", 2)


def test_queries_put_whole_texts_together(spark, tmp_path):
    said = [(1, 0, "user", '{"q": "' + "é𝒳y" * 40 + '"}'), (1, 1, "assistant", "content " * 9), (1, 2, "user", "r" * 24), (1, 4, "user", "more " * 7), (1, 6, "user", " and the rest of call 0"), (2, 0, "user", ""), (2, 1, "user", None)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    calls = {(r["request_id"], r["idx"]): (r["id"], r["name"], r["args"]) for r in registry.QUERIES["reassemble_calls_whole"](spark, str(tmp_path)).collect()}
    assert calls == {(1, 0): ("id-1", "tool0", said[0][3] + said[4][3]), (2, 0): ("id-2", "tool0", "")}
    folded = {r["request_id"]: (r["content"], r["reasoning"], r["n_calls"]) for r in registry.QUERIES["fold_reasoning_whole"](spark, str(tmp_path)).collect()}
    assert folded == {1: (said[1][3] + said[3][3], said[2][3], 1), 2: ("", "", 1)}


def test_late_answers_find_their_calls(spark, tmp_path):
    said = [(1, t, "assistant", "a") for t in (1, 2, 43, 45)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["turn"]: r["name"] for r in registry.QUERIES["pair_tool_results"](spark, str(tmp_path)).collect()}
    assert found == {1: "tool0", 2: "unknown", 43: "tool0", 45: "tool2"}


ACTIONS = [
    ('{"action": "click"}', "click needs elementId"), ('{"action": "click", "elementId": 4}', None), ('{"action": "click", "elementId": 4.5}', "click needs elementId"), ('{"action": "fly"}', "action must"),
    ('{"action": "wait", "seconds": 99}', None), ('{"action": "wait"}', "wait needs"), ('{"action": "scroll", "direction": "in"}', "direction must"), ('{"action": "tab", "op": "switch"}', "tab switch"),
    ('{"action": "tab", "op": "list"}', None), ('{"action": "type"}', "type needs"), ('{"action": "evaluate", "code": "  "}', "evaluate needs"), ("[]", "payload"), (None, "payload"), ('{"action": "back"}', None),
]


def test_actions(spark):
    good, bad = chat.validate_actions(spark.createDataFrame([(i, p) for i, (p, _) in enumerate(ACTIONS)], "id int, payload string"), "payload")
    assert sorted(r["id"] for r in good.collect()) == [i for i, (_, e) in enumerate(ACTIONS) if e is None]
    assert good.where("call.action = 'wait'").first()["call"]["seconds"] == 30
    assert all(r["error"].startswith(ACTIONS[r["id"]][1]) for r in bad.collect())


def test_tokens_roles_and_stops(spark):
    df = spark.createDataFrame([(1, "<|channel|>analysis<|message|>  So <b>"), (2, "the final answer"), (3, None)], "id int, text string")
    assert [r["text"] for r in chat.strip_control_tokens(df, "text").orderBy("id").collect()] == ["So <b>", "the final answer", None]
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "system", "s"), (1, 3, "assistant", "c"), (1, 4, "user", "d")], "conv_id int, turn int, role string, text string")
    assert [tuple(r) for r in chat.merge_same_role(turns).orderBy("island").collect()] == [(1, 0, "system", "s"), (1, 1, "user", "a\n\nb"), (1, 2, "assistant", "c"), (1, 3, "user", "d")]
    stops = spark.createDataFrame([("END_TURN", 0), (None, 0), ("odd", 0), ("stop", 2), ("safety", 0)], "raw string, n int")
    assert [r["stop"] for r in chat.stop_reason(stops, "raw", "n").collect()] == ["stop", "stop", "error", "tool_calls", "content_filter"]
    calls = spark.createDataFrame([(1, "x", "find")], "conv_id int, call_id string, name string")
    assert [r["name"] for r in chat.pair_tool_results(spark.createDataFrame([(1, "x"), (1, "y")], "conv_id int, call_id string"), calls).orderBy("call_id").collect()] == ["find", "unknown"]


@pytest.fixture
def files(spark, tmp_path):
    """Writes batches one after the other and reads them as a stream, a file at a time."""

    def make(name, schema, *batches):
        where = f"{tmp_path}/{name}"
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)

    return make


def run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


CHATS = "conv_id long, turn long, text string"
BATCHES = [(1, 0, "a@x.com b@x.com"), (2, 0, "b@x.com")], [(1, 1, "b@x.com c@x.com"), (1, 2, "no one")]


def test_stream_redaction_is_as_batch(spark, files):
    got = run(streams.stream_redact(files("chats", CHATS, *BATCHES), ["conv_id", "turn"], "text"), "redacted")
    want = redact.redact_drop(spark.createDataFrame([r for b in BATCHES for r in b], CHATS), ["conv_id", "turn"], "text")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_stream_vault_is_as_batch(spark, files):
    got = run(streams.stream_vault(files("mint", CHATS, *BATCHES), "conv_id", "turn", "text"), "minted")
    found = identify.find_identifiers(spark.createDataFrame([r for b in BATCHES for r in b], CHATS), ["conv_id", "turn"], "text")
    want = vault.handle_numbering(found, "conv_id", ["turn", "start"])
    assert sorted((r["scope"], r["handle"], r["value"]) for r in got.collect()) == sorted((str(r["conv_id"]), r["handle"], r["value"]) for r in want.collect())


def test_stream_reassembly_waits_for_the_finish(spark, files):
    got = run(streams.stream_reassemble(files("chunks", CHUNK_SCHEMA, CHUNKS[:3], CHUNKS[3:])), "calls")
    assert {(r["request_id"], r["idx"]): (r["id"], r["name"], r["args"]) for r in got.collect()} == CALLS


EGRESS = "request_id int, at timestamp, url string, body string"
ASKED = [(1, None, "https://api.example.com/", "{}"), (2, None, "https://api.example.com/", '{"a": "a@x.com"}')], [(3, None, "https://no.example.com/", "{}"), (4, None, None, "{}")]


def test_stream_egress(spark, files, tmp_path):
    """Each request is judged once; the listener hears of every batch; a batch that is done again adds nothing."""
    hosts = spark.createDataFrame([("api.example.com",)], "host string")
    heard, fail = [], [True]

    def listen(rows, number):
        heard.append((number, sorted((r["request_id"], r["allowed"]) for r in rows.collect())))
        if number == 1 and fail:
            fail.clear()
            raise RuntimeError("lost between the verdicts and the end of the batch")

    stream = files("requests", EGRESS, *ASKED)
    start = lambda: streams.stream_egress(stream, hosts, f"{tmp_path}/verdicts", f"{tmp_path}/checkpoint", listener=listen)
    with pytest.raises(Exception, match="lost between"):
        start().awaitTermination(120)
    start().awaitTermination(120)
    assert heard == [(0, [(1, True), (2, False)]), (1, [(3, False), (4, False)]), (1, [(3, False), (4, False)])]
    assert [(r["request_id"], r["batch"]) for r in streams.passed(spark, f"{tmp_path}/verdicts").collect()] == [(1, 0)]
    got = {r["request_id"]: r["reason"] for r in streams.refused(spark, f"{tmp_path}/verdicts").collect()}
    assert len(got) == 3 and streams.judged(spark, f"{tmp_path}/verdicts").count() == 4
    want = egress.egress_verdict(spark.createDataFrame([r for b in ASKED for r in b], EGRESS), hosts)
    assert got == {r["request_id"]: r["reason"] for r in want.where("not allowed").collect()}


def test_replies_on_two_streams(spark, files):
    """Answers in time are found across batches; unanswered requests come out once nothing can answer them; what comes too late is dropped and counted."""
    at = lambda s: datetime(2026, 1, 1, 12) + timedelta(seconds=s)
    shape = "nonce string, source string, ts timestamp"
    asked = files("asked", shape, [("n1", "w", at(0)), ("n2", "w", at(1))], [("n3", "w", at(60))], [("end", "w", at(9000))], [("end", "w", at(9001))], [("end", "w", at(9002))])
    said = files("said", shape, [("n1", "w", at(5)), ("n2", "other", at(2))], [("n3", "w", at(69))], [("end", "x", at(9000))], [("n2", "w", at(3)), ("end", "x", at(9001))], [("end", "x", at(9002))])
    out = streams.stream_replies(asked, said, "10 seconds", "5 seconds")
    query = out.writeStream.format("memory").queryName("replies").trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {r["nonce"]: r["reply_ts"] for r in spark.table("replies").where("nonce <> 'end'").collect()}
    assert got == {"n1": at(5), "n2": None, "n3": at(69)}
    assert streams.late_rows(query) == 1


def test_replies_in_time_from_the_same_source(spark):
    at = lambda ms: F.expr(f"timestamp_millis({ms})")
    asked = spark.createDataFrame([("n1", "w"), ("n2", "w"), ("n3", "w"), ("n4", "w")], "nonce string, source string").withColumn("ts", at(1000))
    replies = spark.createDataFrame([("n1", "w", 100), ("n2", "w", 300), ("n3", "other", 100)], "nonce string, source string, ms int")
    replies = replies.select("nonce", "source", F.expr("timestamp_millis(1000 + ms)").alias("ts"))
    assert {r["nonce"]: r["answered"] for r in streams.reply_match(asked, replies).collect()} == {"n1": True, "n2": False, "n3": False, "n4": False}
