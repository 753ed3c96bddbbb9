"""Operators on chat logs: control tokens, turns, call fragments, stop reasons and call checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import BLANK

#: The markers and the channel names that may follow one.
MARKERS = ("channel", "message", "start", "end", "return", "constrain", "assistant", "system", "user")
CHANNELS = ("thought", "thinking", "analysis", "commentary", "final")
#: Spellings of stop reasons.
STOP_REASONS = {
    "stop": ("stop", "end_turn", "stop_sequence"),
    "length": ("length", "max_tokens", "model_length"),
    "tool_calls": ("tool_calls", "function_call", "tool_use"),
    "content_filter": ("content_filter", "safety"),
    "abort": ("abort", "cancelled"),
}
ACTIONS = ("click", "type", "scroll", "wait", "goto", "back", "forward", "tab", "evaluate")
MAX_WAIT = 30


def without_control_tokens(text: Column) -> Column:
    marked = F.contains(text, F.lit("<|")) | F.contains(text, F.lit("|>"))
    named = F.regexp_replace(text, rf"(?i)<\|?channel\|?>[ \t]*(?:{'|'.join(CHANNELS)})?", "")
    bare = F.regexp_replace(named, rf"(?i)<\|?(?:{'|'.join(MARKERS)})\|?>", "")
    return F.when(marked, F.regexp_replace(bare, f"^{BLANK}+", "")).otherwise(text)


def strip_control_tokens(df: DataFrame, text: str) -> DataFrame:
    """A model's channel markers, and the channel name after one, leave the text."""
    return df.withColumn(text, without_control_tokens(F.col(text)))


def stop_reason(df: DataFrame, raw: str, n_calls: str | None = None) -> DataFrame:
    """``df`` with ``stop``: one of the known reasons; nothing said is a stop, an unknown word an error, a call wins."""
    word = F.lower(F.col(raw))
    reason = F.when(F.coalesce(word, F.lit("")) == "", "stop")
    for known, spellings in STOP_REASONS.items():
        reason = reason.when(word.isin(*spellings), known)
    reason = reason.otherwise("error")
    return df.withColumn("stop", F.when(F.col(n_calls) > 0, "tool_calls").otherwise(reason) if n_calls else reason)


def _in_order(value: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("seq").alias("seq"), value.alias("v")))), lambda x: x["v"]), "")


def _last(column: str) -> Column:
    return F.max_by(F.col(column), F.when(F.coalesce(F.col(column), F.lit("")) != "", F.col("seq")))


def reassemble_calls(chunks: DataFrame) -> DataFrame:
    """``request_id, idx, id, name, args`` from fragments ``(request_id, seq, channel, idx, id, name, args_fragment)``."""
    calls = chunks.where(F.col("idx").isNotNull()).groupBy("request_id", "idx")
    out = calls.agg(_last("id").alias("id"), _last("name").alias("name"), _in_order(F.coalesce("args_fragment", F.lit(""))).alias("args"))
    return out.withColumn("id", F.coalesce("id", F.concat(F.lit("call_"), F.col("idx").cast("string"))))


def fold_reasoning(chunks: DataFrame) -> DataFrame:
    """``request_id, content, reasoning, n_calls``: the channels of a stream put together in order."""
    of = lambda channel: _in_order(F.when(F.col("channel") == channel, F.coalesce("args_fragment", F.lit(""))).otherwise(F.lit("")))
    return chunks.groupBy("request_id").agg(of("content").alias("content"), of("reasoning").alias("reasoning"), F.countDistinct(F.when(F.col("channel") == "call", F.col("idx"))).alias("n_calls"))


def merge_same_role(conversations: DataFrame) -> DataFrame:
    """``conv_id, island, role, text``: turns of one role in a row become one; system turns go first, as island 0."""
    system = conversations.where(F.col("role") == "system").withColumn("island", F.lit(0).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    changed = F.when(F.lag("role").over(order).eqNullSafe(F.col("role")), 0).otherwise(1)
    rest = conversations.where(~F.col("role").eqNullSafe(F.lit("system"))).withColumn("_changed", changed)
    rest = rest.withColumn("island", F.sum("_changed").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return system.unionByName(rest).groupBy("conv_id", "island", "role").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n\n").alias("text"))


def pair_tool_results(results: DataFrame, calls: DataFrame) -> DataFrame:
    """``results(conv_id, call_id, ...)`` with ``name`` of the call that they answer, or ``unknown``."""
    known = calls.select("conv_id", "call_id", "name").dropDuplicates(["conv_id", "call_id"])
    return results.join(known.hint("merge"), ["conv_id", "call_id"], "left").withColumn("name", F.coalesce("name", F.lit("unknown")))


#: What a call may carry, as its JSON has it; numbers come as doubles, so that 2.5 is not taken for an id.
PAYLOAD = (
    "action string, elementId double, text string, keys string, direction string, code string, seconds double, op string, tabId double, url string, "
    "button string, clicks double, newTab boolean, clear boolean, pressEnter boolean, amount double, isSensitive boolean, expectKind string"
)


def checked_actions(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with the parsed ``call`` and the first ``error`` of each payload, null if it is good; long waits are cut."""
    call = F.from_json(F.col(payload), PAYLOAD)
    rows = df.withColumn("call", call)
    is_object = F.col(payload).rlike(r"^\s*\{")
    whole = lambda field: F.col(f"call.{field}").isNotNull() & (F.col(f"call.{field}") == F.floor(f"call.{field}"))
    text = lambda field: F.coalesce(F.col(f"call.{field}"), F.lit("")) != ""
    action = F.col("call.action")
    error = (
        F.when(~F.coalesce(is_object, F.lit(False)), "payload must be an object")
        .when(~F.coalesce(action.isin(*ACTIONS), F.lit(False)), F.lit("action must be one of: " + ", ".join(ACTIONS)))
        .when((action == "click") & ~F.coalesce(whole("elementId"), F.lit(False)), "click needs elementId")
        .when((action == "type") & ~(text("text") | text("keys") | F.coalesce(whole("elementId"), F.lit(False))), "type needs text, keys or elementId")
        .when((action == "scroll") & text("direction") & ~F.col("call.direction").isin("up", "down", "left", "right"), "direction must be up, down, left or right")
        .when((action == "evaluate") & (F.trim(F.coalesce("call.code", F.lit(""))) == ""), "evaluate needs code")
        .when((action == "wait") & ~F.coalesce(F.col("call.seconds") >= 0, F.lit(False)), "wait needs seconds")
        .when((action == "tab") & ~F.coalesce(F.col("call.op").isin("list", "switch", "close", "new"), F.lit(False)), "op must be list, switch, close or new")
        .when((action == "tab") & F.col("call.op").isin("switch", "close") & ~F.coalesce(whole("tabId"), F.lit(False)), F.concat(F.lit("tab "), F.col("call.op"), F.lit(" needs tabId")))
    )
    cut = F.when(action == "wait", F.col("call").withField("seconds", F.least("call.seconds", F.lit(float(MAX_WAIT))))).otherwise(F.col("call"))
    for field in ("elementId", "tabId", "clicks", "amount"):  # a number that is not whole counts as none
        cut = cut.withField(field, F.when(whole(field), F.col(f"call.{field}")))
    return rows.withColumns({"error": error, "call": cut})


def validate_actions(df: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """Good rows with ``call``, and the others with ``error``."""
    rows = checked_actions(df, payload)
    return rows.where(F.col("error").isNull()).drop("error"), rows.where(F.col("error").isNotNull()).drop("call")
