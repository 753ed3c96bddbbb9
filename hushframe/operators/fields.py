"""What form fields, and table columns, declare about their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.detectors import DETECTORS, all_detected
from ..functions.expressions import EDGE

#: Autocomplete tokens and the kind that each declares.
AUTOCOMPLETE = {
    "current-password": "password",
    "new-password": "password",
    "one-time-code": "one-time-code",
    "cc-number": "cc-number",
    "cc-csc": "cc-csc",
    "cc-exp": "cc-exp",
    "cc-exp-month": "cc-exp",
    "cc-exp-year": "cc-exp",
    "cc-name": "name",
    "name": "name",
    "given-name": "name",
    "family-name": "name",
    "additional-name": "name",
    "email": "email",
    "tel": "tel",
    "tel-national": "tel",
    "tel-local": "tel",
    "street-address": "street-address",
    "address-line1": "street-address",
    "address-line2": "street-address",
    "postal-code": "postal-code",
    "bday": "bday",
    "bday-day": "bday",
    "bday-month": "bday",
    "bday-year": "bday",
}
#: Words of labels and the kind that each suggests; the first that matches wins.
LABEL_WORDS = [
    ("postal-code", r"pin[\s-]?code|pincode|postal|zip"),
    ("password", "password|passwd|passphrase"),
    ("password", "pin"),
    ("one-time-code", r"otp|one[\s-]?time|verification code|auth code"),
    ("cc-csc", "cvv|cvc|security code|card verification"),
    ("aadhaar", "aadhaar|aadhar|uidai"),
    ("pan", r"pan[\s-]?(?:number|card|no)|permanent account"),
    ("cc-number", r"card[\s-]?(?:number|no)|cardno|credit card|debit card"),
    ("account", r"account[\s-]?(?:number|no)|ifsc|ssn|passport"),
    ("cc-exp", "expiry|expiration|valid thru"),
    ("email", "e-?mail"),
    ("tel", "phone|mobile|contact number"),
    ("street-address", "address|street"),
    ("bday", r"date[\s-]?of[\s-]?birth|dob|birthday|birth[\s-]?date"),
    ("name", r"(?:first|last|full|given|middle|sur|family)[\s-]?name"),
    ("name", r"name[\s-]?on[\s-]?card"),
]
#: Input types that declare a kind, and those that hold no typed text.
TYPE_KINDS = ("password", "email", "tel")
NOT_TYPED = ("checkbox", "radio", "submit", "button")


def identifier_words(text: Column) -> Column:
    """``userEmail`` and ``card_number`` as separate words."""
    return F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), r"[_.\-]+", " ")


def split_identifier(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("words", identifier_words(F.col(column)))


def label_kind(words: Column) -> Column:
    """The kind that a label suggests, or null."""
    tests = [F.when(words.rlike(f"(?i){EDGE}(?:{pattern}){EDGE}"), kind) for kind, pattern in LABEL_WORDS]
    return F.coalesce(*tests)


def autocomplete_kind(value: Column) -> Column:
    """The kind of the last token that is known, or null."""
    known = F.create_map(*[F.lit(x) for pair in AUTOCOMPLETE.items() for x in pair])
    tokens = F.split(F.trim(F.lower(value)), r"\s+")
    kinds = F.filter(F.transform(tokens, lambda t: F.try_element_at(known, t)), lambda k: k.isNotNull())
    return F.try_element_at(kinds, F.lit(-1))


def type_kind(tag: Column, kind: Column) -> Column:
    return F.when((tag == "input") & F.lower(kind).isin(*TYPE_KINDS), F.lower(kind))


def classify_type(df: DataFrame, tag: str = "tag", kind: str = "type") -> DataFrame:
    return df.withColumn("kind", type_kind(F.col(tag), F.col(kind)))


def classify_autocomplete(df: DataFrame, column: str = "autocomplete") -> DataFrame:
    return df.withColumn("kind", autocomplete_kind(F.col(column)))


def classify_label(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("kind", label_kind(identifier_words(F.col(column))))


def field_kind(tag: Column, type_: Column, autocomplete: Column, role: Column, editable: Column, label: Column) -> Column:
    """Declared type first, then autocomplete, then the wording, which counts only where text can be typed."""
    is_input = tag == "input"
    takes_text = is_input | (tag == "textarea") | F.coalesce(role == "textbox", F.lit(False)) | editable
    final = is_input & F.coalesce(F.lower(type_).isin(*NOT_TYPED), F.lit(False))
    worded = F.when(takes_text, label_kind(identifier_words(label)))
    return F.when(~final, F.coalesce(type_kind(tag, type_), autocomplete_kind(autocomplete), worded))


def classify_fields(fields: DataFrame) -> DataFrame:
    """``fields(tag, type, autocomplete, aria_label, name, placeholder, id, label)`` with ``sensitive``; ``role`` and ``editable`` count if there."""
    has = set(fields.columns)
    role = F.col("role") if "role" in has else F.lit(None).cast("string")
    editable = F.coalesce(F.col("editable"), F.lit(False)) if "editable" in has else F.lit(False)
    words = F.concat_ws(" ", *["aria_label", "name", "placeholder", "id"], F.when(F.col("tag").isin("input", "textarea"), F.col("label")))
    return fields.withColumn("sensitive", field_kind(F.col("tag"), F.col("type"), F.col("autocomplete"), role, editable, words))


def fields_to_mask(elements: DataFrame) -> DataFrame:
    """``page_id, node_id, kind, bounds`` of fields that are classified and filled."""
    filled = F.exists("states", lambda s: s.startswith("value="))
    return elements.where(F.col("sensitive").isNotNull() & filled).select("page_id", "node_id", F.col("sensitive").alias("kind"), "bounds")


def classify_columns(df: DataFrame, share: float = 0.5) -> DataFrame:
    """``column, by_name, by_value, n_values, n_found``: what each column's name suggests, and what its values hold.

    ``by_value`` is the kind of identifier in the largest part of a column's non-null values, if
    that is at least ``share`` of them; ties go to the kind that detectors name first. Columns
    are read as strings, all in one pass, and counted before anything is shuffled.
    """
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    value = F.col("_c.value")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in plain])).alias("_c"))
    held = F.array_distinct(F.transform(all_detected(value, DETECTORS), lambda s: s["kind"]))
    counts = cells.select("_c.column", value.isNotNull().alias("there"), held.alias("kinds"))
    kinds = dict.fromkeys(d.kind for d in DETECTORS)
    found = counts.groupBy("column").agg(F.count_if("there").alias("n_values"), *[F.count_if(F.array_contains("kinds", k)).alias(f"_{i}") for i, k in enumerate(kinds)])
    most = F.greatest(*[F.col(f"_{i}") for i in range(len(kinds))])
    first = F.coalesce(*[F.when(F.col(f"_{i}") == most, k) for i, k in enumerate(kinds)])
    return classify_label(found, "column").select("column", F.col("kind").alias("by_name"), F.when((most > 0) & (most >= share * F.col("n_values")), first).alias("by_value"), "n_values", most.alias("n_found"))
