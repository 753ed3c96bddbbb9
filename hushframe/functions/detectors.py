"""Detectors of personal identifiers in text, and their spans as array columns.

A detector is a pattern and a predicate on what it matches. All of a text's matches of one
pattern are taken first; those that fail the predicate still consume their text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import BLANK, EDGE, bound, check_of_digits, digits_only, luhn_ok, verhoeff_ok

#: What a value may be, in the vocabulary of forms and redaction markers.
KINDS = (
    "password", "one-time-code", "cc-number", "cc-csc", "cc-exp", "email", "tel", "street-address",
    "postal-code", "bday", "name", "aadhaar", "pan", "gstin", "ifsc", "account",
)
#: Holder types, the fourth letter of a tax number.
PAN_HOLDERS = "ABCFGHJLPTKE"
SPAN = "array<struct<start:int,end:int,rank:int,text:string,kind:string>>"


@dataclass(frozen=True)
class Detector:
    """``hint`` is a cheap pattern that every text with a match has; texts without it are not searched."""

    kind: str
    pattern: str
    accept: Callable[[Column], Column] | None = None
    hint: str | None = None


def pan_ok(text: Column) -> Column:
    return text.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$") & F.substring(text, 4, 1).isin(*PAN_HOLDERS)


def gstin_ok(text: Column) -> Column:
    state = F.substring(text, 1, 2).try_cast("int")
    return F.coalesce((state.between(1, 38) | state.isin(97, 99)) & pan_ok(F.substring(text, 3, 10)), F.lit(False))


def card_ok(text: Column) -> Column:
    return check_of_digits(text, lambda digits, both: F.char_length(digits).between(13, 19) & luhn_ok(digits, both))


def phone_ok(text: Column) -> Column:
    return bound(digits_only(text), lambda digits: (F.char_length(digits) == 10) | ((F.char_length(digits) == 12) & digits.startswith("91")))


#: The published formats, in the order that breaks ties. The first class, once more in
#: front, spares the edge's look-around at all other characters.
DETECTORS = [
    Detector("email", f"{EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}{EDGE}", None, "@"),
    Detector("gstin", f"(?=[0-9]){EDGE}[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][A-Z0-9]Z[A-Z0-9]{EDGE}", gstin_ok, "[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]"),
    Detector("ifsc", f"(?=[A-Z]){EDGE}[A-Z]{{4}}0[A-Z0-9]{{6}}{EDGE}", None, "[A-Z]{4}0[A-Z0-9]{6}"),
    Detector("pan", f"(?=[A-Z]){EDGE}[A-Z]{{5}}[0-9]{{4}}[A-Z]{EDGE}", pan_ok, "[A-Z]{5}[0-9]{4}[A-Z]"),
    Detector("cc-number", f"(?=[0-9]){EDGE}(?:[0-9][ -]?){{12,18}}[0-9]{EDGE}", card_ok, "(?:[0-9][ -]?){12}[0-9]"),
    Detector("aadhaar", f"(?=[2-9]){EDGE}[2-9][0-9]{{3}}[ -]?[0-9]{{4}}[ -]?[0-9]{{4}}{EDGE}", lambda text: check_of_digits(text, verhoeff_ok), "[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
    Detector("tel", f"(?=[+6-9])(?:\\+?91(?:{BLANK}|-)?)?{EDGE}[6-9][0-9]{{4}}(?:{BLANK}|-)?[0-9]{{5}}{EDGE}", phone_ok, f"[6-9][0-9]{{4}}(?:{BLANK}|-)?[0-9]{{5}}"),
]


def register_detector(kind: str, pattern: str, accept: Callable[[Column], Column] | None = None) -> Detector:
    """Adds a detector after the others; ``accept`` makes a predicate column of a match."""
    DETECTORS.append(added := Detector(kind, pattern, accept))
    return added


def detector(kind: str) -> Detector:
    return next(d for d in DETECTORS if d.kind == kind)


def placed(gaps: Column, found: Column, span: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """``span(match, start, nth)`` of each match, from the pieces between them: one walk that carries the place."""
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(0).alias("upto"))

    def step(acc: Column, i: Column) -> Column:
        at = acc["upto"] + F.char_length(F.get(gaps, i))
        match = F.get(found, i)
        return F.struct(F.concat(acc["out"], F.array(span(match, at, i))).alias("out"), (at + F.char_length(match)).alias("upto"))

    return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])


def pattern_matches(text: Column, pattern: str, span: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """``span(match, start, nth)``, a struct of the type ``kind``, of all matches of a pattern; places are in code points.

    Spark gives matches without places: they follow from the lengths of the pieces between. The
    text is cut only if there is a match.
    """
    none = F.array().cast(f"array<{kind}>")
    with_gaps = lambda b: bound(F.split(b["t"], pattern, -1), lambda gaps: placed(gaps, b["f"], span, kind))
    both = F.struct(text.alias("t"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"))
    return bound(both, lambda b: F.when(F.size(b["f"]) > 0, with_gaps(b)).otherwise(none))


def pattern_spans(text: Column, pattern: str, rank: int = 0, kind: str = "") -> Column:
    """All matches of a pattern as an array of spans, left to right."""

    def span(match: Column, start: Column, _: Column) -> Column:
        return F.struct(start.alias("start"), (start + F.char_length(match)).alias("end"), F.lit(rank).alias("rank"), match.alias("text"), F.lit(kind).alias("kind"))

    return pattern_matches(text, pattern, span, SPAN[len("array<") : -1])


def hinted(text: Column, which: Detector) -> Column:
    return F.contains(text, F.lit(which.hint)) if which.hint == "@" else text.rlike(which.hint)


def detected(text: Column, which: Detector, rank: int = 0) -> Column:
    """Accepted spans of one detector; none where its hint is missing."""
    spans = pattern_spans(text, which.pattern, rank, which.kind)
    if which.accept:
        spans = F.filter(spans, lambda s: which.accept(s["text"]))
    if which.hint is None:
        return F.coalesce(spans, F.array().cast(SPAN))
    return F.when(hinted(text, which), spans).otherwise(F.array().cast(SPAN))


def worth_a_search(text: Column) -> Column:
    """A necessary condition of all built-in detectors, in as few passes as can be: each pattern decodes the whole text.

    An address has its sign; a bank code four capitals and a zero; all the others four digits
    with at most one blank or hyphen between two of them.
    """
    bank = F.contains(text, F.lit("0")) & text.rlike("[A-Z]{4}0")
    return F.contains(text, F.lit("@")) | text.rlike("[0-9](?:[ -]?[0-9]){3}") | bank


def all_detected(text: Column, detectors: list[Detector]) -> Column:
    """Spans of all detectors, one after the other; added detectors are tried on every text."""
    found = F.concat(*[detected(text, d, i) for i, d in enumerate(detectors)])
    if any(d.hint is None for d in detectors):
        return found
    return F.when(worth_a_search(text), found).otherwise(F.array().cast(SPAN))


def without_overlaps(spans: Column) -> Column:
    """Left to right, the longer of two that start together first, then by rank; what starts inside a kept span goes."""
    sort_key = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["rank"].alias("rank"), s.alias("span"))
    start = F.struct(F.array().cast(SPAN).alias("kept"), F.lit(-1).alias("upto"))

    def sweep(acc: Column, x: Column) -> Column:
        taken = F.struct(F.concat(acc["kept"], F.array(x["span"])).alias("kept"), x["span"]["end"].alias("upto"))
        return F.when(x["start"] < acc["upto"], acc).otherwise(taken)

    swept = lambda found: F.aggregate(F.array_sort(F.transform(found, sort_key)), start, sweep, lambda acc: acc["kept"])
    return bound(spans, lambda found: F.when(F.size(found) > 1, swept(found)).otherwise(found))


def spliced(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """``text`` with each span (sorted, disjoint) replaced by ``put(span)``, the rest as it is."""

    def of(s: Column) -> Column:
        before = lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["end"])
        part = lambda x, i: F.concat(F.substr(text, before(x, i) + 1, x["start"] - before(x, i)), put(x))
        rest = F.substr(text, F.element_at(s, -1)["end"] + 1, F.char_length(text))
        return F.when(F.size(s) > 0, F.concat(F.array_join(F.transform(s, part), ""), rest)).otherwise(text)

    return bound(spans, of)
