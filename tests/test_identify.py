"""Detection, redaction and scores on labelled texts, decoys and quirks."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushframe.functions import detectors, expressions
from hushframe.operators import identify, redact, score

IDENTIFIERS = [
    ("2345 6789 0124", "aadhaar"), ("3456 7890 1238", "aadhaar"), ("ABCPE1234F", "pan"), ("AAAPZ1234C", "pan"), ("BXZPM4321K", "pan"),
    ("27ABCPE1234F1Z5", "gstin"), ("HDFC0001234", "ifsc"), ("5555 5555 5555 4444", "cc-number"), ("ravi.menon@example.com", "email"),
    ("+91 98765 43210", "tel"), ("é9876543210", "tel"), ("98765 43210", "tel"),
]
DECOYS = [
    "100234567891", "100234567892", "100234567893", "1735689600000", "₹4,500 · 09:30 · 4021", "1234567812345678", "ABCDE1234F", "2345 6789 0142",
    "1002345678", "+919876543210", "919876543210", "5555 5555 5555 4444 12", "+1 (743) 555-3824", "Ravi Menon",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, f"see {t} there") for i, (t, _) in enumerate(IDENTIFIERS)] + [(100 + i, t) for i, t in enumerate(DECOYS)] + [(200, None), (201, "")]
    return spark.createDataFrame(rows, "id int, text string")


def test_each_identifier_is_found_once_and_no_decoy(texts):
    found = sorted((r["id"], r["kind"]) for r in identify.find_identifiers(texts, "id", "text").collect())
    assert found == [(i, kind) for i, (_, kind) in enumerate(IDENTIFIERS)]


def test_places_are_code_points(texts):
    for r in identify.find_identifiers(texts, "id", "text").join(texts.withColumnRenamed("text", "whole"), "id").collect():
        assert r["whole"][r["start"] : r["end"]] == r["text"]


def test_redaction_keeps_the_rest_and_leaves_nothing(texts):
    out = redact.redact_drop(texts, "id", "text")
    rows = {r["id"]: r for r in out.collect()}
    assert rows[5]["text"] == "see [redacted:gstin] there" and rows[5]["kinds"] == ["gstin"]
    assert rows[200]["text"] is None and rows[201]["text"] == ""
    assert identify.leak_check(out, "id", "text").count() == 0
    again = {r["id"]: r["text"] for r in redact.redact_drop(out, "id", "text").collect()}
    assert again == {i: r["text"] for i, r in rows.items()}


def test_names_are_redacted_before_they_are_cut(spark):
    nodes = spark.createDataFrame([("x" * 70 + " ravi.menon@example.com",)], "name string")
    assert redact.redact_names(nodes).first()["name"] == "x" * 70 + " [redacte…"


def test_a_callable_replaces(texts):
    out = redact.redact_drop(texts.where("id = 8"), "id", "text", put=lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    assert out.first()["text"] == "see <EMAIL> there"


def test_a_registered_detector_is_used(texts, monkeypatch):
    monkeypatch.setattr(detectors, "DETECTORS", list(detectors.DETECTORS))
    added = detectors.register_detector("account", "see [0-9]{4}", lambda text: text.endswith("5555"))
    assert detectors.DETECTORS[-1] is added
    found = identify.find_identifiers(texts, "id", "text", [added]).collect()
    assert [(r["id"], r["text"]) for r in found] == [(7, "see 5555")]


CARDS = ["378 282 246 310 005", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "37 82 82 24 63 10 005"]


def test_cards_in_groups_of_any_size(spark):
    df = spark.createDataFrame([(i, f"pay {t} now") for i, t in enumerate(CARDS)] + [(9, "378 282 246 310 006")], "id int, text string")
    found = identify.find_identifiers(df, "id", "text")
    assert sorted((r["id"], r["text"], r["kind"]) for r in found.collect()) == [(i, t, "cc-number") for i, t in enumerate(CARDS)]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, identify.detect(df, "id", "text", "cc-number").collect()))
    assert identify.leak_check(df, "id", "text").count() == len(CARDS)
    assert {r["text"] for r in redact.redact_drop(df, "id", "text").where("id < 9").collect()} == {"pay [redacted:cc-number] now"}


def test_an_added_detector_is_tried_on_every_text(spark, monkeypatch):
    monkeypatch.setattr(detectors, "DETECTORS", list(detectors.DETECTORS))
    detectors.register_detector("name", "Ravi [A-Z][a-z]+")
    df = spark.createDataFrame([(1, "see Ravi Menon there")], "id int, text string")
    assert [r["text"] for r in identify.find_identifiers(df, "id", "text", detectors.DETECTORS).collect()] == ["Ravi Menon"]


def luhn_digit(digits):
    total = sum((d * 2 - 9 * (d > 4)) if k % 2 == 0 else d for k, d in enumerate(reversed(digits)))
    return -total % 10


def verhoeff_digit(digits):
    product, power = expressions.verhoeff_tables()
    check = 0
    for i, d in enumerate(reversed(digits), 1):
        check = product[check * 10 + power[i % 8 * 10 + d]]
    return next(x for x in range(10) if product[check * 10 + x] == 0)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=2, max_size=18), min_size=20, max_size=20), st.integers(1, 9))
def test_checksums_catch_every_single_digit_error(spark, numbers, step):
    rows = []
    for digits in numbers:
        for name, extra in (("luhn", luhn_digit(digits)), ("verhoeff", verhoeff_digit(digits))):
            whole = [*digits, extra]
            rows.append((name, "".join(map(str, whole)), True))
            wrong = list(whole)
            wrong[len(whole) // 2] = (wrong[len(whole) // 2] + step) % 10
            rows.append((name, "".join(map(str, wrong)), False))
    df = spark.createDataFrame(rows, "name string, number string, right boolean").coalesce(1)
    ok = F.when(F.col("name") == "luhn", expressions.luhn_ok(F.col("number"))).otherwise(expressions.verhoeff_ok(F.col("number")))
    assert df.where(ok != F.col("right")).count() == 0


def test_checksums_refuse_other_text(spark):
    df = spark.createDataFrame([("",), ("12a",), (None,)], "n string")
    assert [tuple(r) for r in df.select(expressions.luhn_ok(F.col("n")), expressions.verhoeff_ok(F.col("n"))).collect()] == [(False, False)] * 3


def test_scores(spark):
    truth = [(1, i * 10, i * 10 + 5, "email", None) for i in range(11)] + [(1, 200 + i * 10, 205 + i * 10, None, "price") for i in range(11)]
    truth = spark.createDataFrame(truth, "page_id long, start int, end int, kind string, decoy_reason string")
    found = spark.createDataFrame([(1, i * 10 + 4, i * 10 + 9, "email") for i in range(10)], "page_id long, start int, end int, kind string")
    one = score.score_detection(found, truth).first()
    assert (one["identifiers"], one["hit"], one["decoys_covered"], one["precision_decoy"], one["precision_span"]) == (11, 10, 0, 1.0, 1.0)
    assert one["recall"] == pytest.approx(10 / 11)
    assert [r["error"] for r in score.score_errors(found, truth).collect()] == ["missed"]
    assert score.quality_gate(found, truth).first()["passed"]
    worse = found.union(spark.createDataFrame([(1, 201, 203, "tel")], found.schema))
    assert not score.quality_gate(worse, truth).first()["passed"]
    assert score.score_detection(worse, truth).first()["precision_span"] == pytest.approx(10 / 11)
    assert score.score_by_kind(found, truth).first()["hit"] == 10


def test_small_forms(spark):
    row = spark.createDataFrame([("  a   b ", "example.org", 'q"x', "abcdefghij", 2_500_000)], "a string, u string, q string, c string, n long")
    got = row.select(expressions.squash(F.col("a")), expressions.with_scheme(F.col("u")), expressions.json_quoted(F.col("q")), expressions.masked(F.col("c")), expressions.human_bytes(F.col("n"))).first()
    assert tuple(got) == ("a b", "https://example.org", '"q\\"x"', "abcd…ghij", "2.4 MB")
