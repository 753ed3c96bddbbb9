"""The vault: values behind handles, minted once, looked up and restored by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detectors import pattern_matches, spliced
from ..functions.materialize import materialized
from ..functions.running import running_sum
from .identify import keys_of, with_spans
from .redact import with_handles

#: What a handle looks like, and one of a session, whose tag may be left out.
HANDLE = r"\[redacted:([a-z-]+)#([a-z0-9-]+)\]"
SESSION_HANDLE = r"\[redacted:([a-z-]+)#s?([0-9]+)\]"
#: Generations for which a value that is no longer seen still resolves.
GRACE = 1
SCHEMA = "scope string, handle string, kind string, value string, n long, seen_gen long"


def _handle(tag: str) -> Column:
    return F.concat("kind", F.lit(f"#{tag}"), F.col("n").cast("string"))


def handle_numbering(found: DataFrame, scope: str, order: list[str], tag: str = "") -> DataFrame:
    """``scope, kind, value, n, handle``: distinct values numbered by first appearance within their scope, however many a scope has."""
    first = found.groupBy(scope, "kind", F.col("text").alias("value")).agg(F.min(F.struct(*order)).alias("at"))
    numbered = running_sum(first.withColumn("_one", F.lit(1).cast("long")), scope, ["at", "kind", "value"], "_one", "n")
    return numbered.select(F.col(scope), "kind", "value", "n", _handle(tag).alias("handle"))


def newly_minted(found: DataFrame, vault: DataFrame, scope: str, order: list[str], gen: int = 0, tag: str = "") -> tuple[DataFrame, DataFrame]:
    """Entries for values that the vault lacks, and ``scope, kind, value`` of all that were seen.

    The vault's largest number of a scope stands first in the scope's order and is what counting
    goes on from, so that nothing is joined by scope and no scope is numbered in one task.
    """
    seen = found.groupBy(F.col(scope).cast("string").alias("scope"), "kind", F.col("text").alias("value")).agg(F.min(F.struct(*order)).alias("at"))
    fresh = seen.join(vault.select("scope", "kind", "value").hint("merge"), ["scope", "kind", "value"], "left_anti").withColumns({"_new": F.lit(1), "_by": F.lit(1).cast("long")})
    last = vault.groupBy("scope").agg(F.max("n").alias("_by")).withColumn("_new", F.lit(0))
    every = fresh.unionByName(last, allowMissingColumns=True)
    counted = running_sum(every, "scope", ["_new", "at", "kind", "value"], "_by", "n").where("_new = 1")
    return counted.select("scope", _handle(tag).alias("handle"), "kind", "value", "n", F.lit(gen).cast("long").alias("seen_gen")), seen.select("scope", "kind", "value")


def vault_mint(found: DataFrame, vault: DataFrame, scope: str, order: list[str], gen: int = 0, tag: str = "") -> DataFrame:
    """The vault with numbers for values that it lacks, and its seen values marked with ``gen``.

    A scope's counter runs over all its kinds, goes on from the largest number ever given and is
    never used twice; the same kind and value keep their handle.
    """
    minted, seen = newly_minted(found, vault, scope, order, gen, tag)
    again = vault.join(seen.withColumn("_seen", F.lit(True)).hint("merge"), ["scope", "kind", "value"], "left")
    kept = again.select("scope", "handle", "kind", "value", "n", F.when(F.col("_seen"), F.lit(gen).cast("long")).otherwise(F.col("seen_gen")).alias("seen_gen"))
    return kept.unionByName(minted)


def vault_lookup(df: DataFrame, vault: DataFrame, handle: str = "handle", scope: str = "scope") -> DataFrame:
    known = vault.select(F.col("scope").alias(scope), F.col("handle").alias(handle), "kind", "value", "n", "seen_gen")
    return df.join(known.hint("merge"), [scope, handle])


def vault_expiry(vault: DataFrame, gen: int, grace: int = GRACE) -> DataFrame:
    """Entries that still resolve. The others' numbers stay used: keep the full vault to mint from."""
    return vault.where(F.lit(gen) - F.col("seen_gen") <= grace)


def redact_conversations(conversations: DataFrame) -> DataFrame:
    """Each conversation redacted with a vault of its own, values numbered by turn and place.

    Spans are found once and written; numbers and texts both follow from them.
    """
    key = ["conv_id", "turn"]
    rows = materialized(with_spans(conversations.select(*key, "role", "text"), "text", name="_spans"))
    found = rows.select(*key, F.explode("_spans").alias("s")).select(*key, "s.start", "s.kind", "s.text")
    vault = handle_numbering(found, "conv_id", ["turn", "start"], tag="s").withColumnRenamed("conv_id", "scope")
    return with_handles(rows, [*key, "role"], "text", vault, "conv_id").select(*key, "role", "text")


TOKEN = "struct<nth:int,start:int,end:int,kind:string,number:string,token:string>"


def _tokens(text: Column, pattern: str) -> Column:
    """Handles in a text with their places: kind, id, start, end."""

    def token(match: Column, start: Column, nth: Column) -> Column:
        return F.struct(nth.alias("nth"), start.alias("start"), (start + F.char_length(match)).alias("end"), F.regexp_extract(match, pattern, 1).alias("kind"), F.regexp_extract(match, pattern, 2).alias("number"), match.alias("token"))

    return F.when(F.contains(text, F.lit("[redacted:")), pattern_matches(text, pattern, token, TOKEN))


def _expanded(df: DataFrame, keys: list[str], text: str, pattern: str, vault: DataFrame, scope: str, tag: str) -> DataFrame:
    """``df`` with ``_tokens``: each handle of the text with the vault's entry, in order."""
    rows = df.select(*dict.fromkeys([*keys, scope]), F.explode_outer(_tokens(F.col(text), pattern)).alias("t")).where(F.col("t").isNotNull())
    rows = rows.withColumn("handle", F.concat("t.kind", F.lit(f"#{tag}"), "t.number"))
    entries = vault.select(F.col("scope").alias(scope), "handle", F.struct("kind", "value", "seen_gen").alias("entry"))
    met = rows.join(entries.hint("merge"), [scope, "handle"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t.nth", "t.start", "t.end", "t.token", "entry"))).alias("_tokens"))
    empty = F.array().cast("array<struct<nth:int,start:int,end:int,token:string,entry:struct<kind:string,value:string,seen_gen:bigint>>>")
    return df.join(met.hint("merge"), keys, "left").withColumn("_tokens", F.coalesce("_tokens", empty))


def rehydrate(df: DataFrame, key: str | list[str], text: str, target_kind: str, vault: DataFrame, gen: int, scope: str = "scope", grace: int = GRACE) -> DataFrame:
    """``key, ok, text, used, error``: handles expanded, but only into a target of their own kind.

    The first handle that is unknown, stale or of another kind refuses the row, and its text is
    null then. Values are put in as they are; nothing in them is taken for a pattern.
    """
    keys = keys_of(key)
    rows = _expanded(df, keys, text, HANDLE, vault, scope, "")

    def fault(t: Column) -> Column:
        gone = t["entry"].isNull() | (F.lit(gen) - t["entry"]["seen_gen"] > grace)
        other = ~F.col(target_kind).eqNullSafe(t["entry"]["kind"])
        return F.when(gone, F.concat(t["token"], F.lit(" is unknown or stale"))).when(other, F.concat(t["entry"]["kind"], F.lit(" cannot go into "), F.coalesce(F.col(target_kind), F.lit("an undeclared field"))))

    faults = F.filter(F.transform("_tokens", fault), lambda x: x.isNotNull())
    rows = rows.withColumn("error", F.get(faults, 0))
    whole = spliced(F.col(text), F.col("_tokens"), lambda t: t["entry"]["value"])
    ok = F.col("error").isNull()
    return rows.select(*keys, ok.alias("ok"), F.when(ok, whole).alias("text"), F.when(ok, F.transform("_tokens", lambda t: t["entry"]["kind"])).alias("used"), "error")


def restore_session(df: DataFrame, key: str | list[str], text: str, vault: DataFrame, scope: str = "scope") -> DataFrame:
    """``key, text, kinds``: session handles expanded, with or without their tag; unknown ones stay as they stand."""
    keys = keys_of(key)
    rows = _expanded(df, keys, text, SESSION_HANDLE, vault, scope, "s")
    out = spliced(F.col(text), F.col("_tokens"), lambda t: F.coalesce(t["entry"]["value"], t["token"]))
    kinds = F.filter(F.transform("_tokens", lambda t: t["entry"]["kind"]), lambda k: k.isNotNull())
    return rows.select(*keys, out.alias("text"), kinds.alias("kinds"))


def expected_kind_check(actions: DataFrame, fields: DataFrame, on: list[str]) -> DataFrame:
    """``actions(expected_kind)`` joined with ``fields(kind)``: a restored value must match its field; ``ok, error``."""
    met = actions.join(fields.select(*on, F.col("kind").alias("field_kind")), on, "left")
    ok = F.col("expected_kind").isNull() | F.col("expected_kind").eqNullSafe(F.col("field_kind"))
    return met.withColumns({"ok": ok, "error": F.when(~ok, F.concat("expected_kind", F.lit(" cannot go into "), F.coalesce("field_kind", F.lit("an undeclared field"))))})
