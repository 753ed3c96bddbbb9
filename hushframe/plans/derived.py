"""Tables that queries derive from the given ones, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread, table


def letter(number: str, place: int) -> str:
    return f"substring('ABCDEFGHIJ', cast(floor(({number}) / {10**place}) as bigint) % 10 + 1, 1)"


KEY = "c_custkey * 7919 + 1234"
PAN = f"{letter(KEY, 4)} || {letter(KEY, 3)} || {letter(KEY, 2)} || {letter(KEY, 1)} || {letter(KEY, 0)} || lpad(cast(c_custkey % 10000 as string), 4, '0') || {letter(KEY, 2)}"
GSTIN = f"lpad(cast(c_nationkey * 2 as string), 2, '0') || {PAN} || '1Z5'"
IFSC = f"{letter(KEY, 0)} || {letter(KEY, 1)} || {letter(KEY, 2)} || {letter(KEY, 3)} || '0' || lpad(cast(c_custkey % 1000000 as string), 6, '0')"
PHONE = "cast(6000000000 + (c_custkey * 104729) % 3999999999 as string)"
PHONE_TEXT = f"case c_custkey % 4 when 0 then {PHONE} when 1 then substring({PHONE}, 1, 5) || ' ' || substring({PHONE}, 6, 5) when 2 then '+91 ' || substring({PHONE}, 1, 5) || '-' || substring({PHONE}, 6, 5) else '+91' || {PHONE} end"
MAIL = "'user.' || cast(c_custkey as string) || '@mail' || cast(c_nationkey as string) || '.example.com'"
UID = "cast(200000000000 + c_custkey * 7919 as string)"
CARD = "cast(4000000000000000 + c_custkey * 10007 as string)"

#: name: (base table, columns)
DERIVED: dict[str, tuple[str, str]] = {
    "aadhaar_numbers": ("orders", "o_orderkey as id, cast(200000000000 + o_orderkey * 7919 as string) as number"),
    "card_numbers": ("lineitem", "l_orderkey as id, l_linenumber as line, cast(4000000000000000 + l_orderkey * 10007 + l_linenumber as string) as number"),
    "identity_texts": (
        "customer",
        f"c_custkey as id, c_mktsegment as segment, 'Tax ' || {GSTIN} || ', own ' || {PAN} || '; bank ' || {IFSC} || ' call ' || {PHONE_TEXT} || ' mail ' || {MAIL} || ' uid ' || {UID} || ' card ' || {CARD} || ' order ' || cast(1735689600000 + c_custkey as string) as text",
    ),
    "chats": (
        "conversations",
        "conv_id, turn, role, text || ' Write to user' || cast(turn % 3 as string) || '@example.com or ' || cast(9000000000 + conv_id * 3 + turn % 2 as string) || '.' as text",
    ),
    "requests": (
        "conversations",
        "conv_id * 1000 + turn as request_id, case conv_id % 5 when 0 then 'https://api.example.com/v1/chat' when 1 then 'https://evil.example.net/x?y=1' when 2 then 'data:text/plain,abc' when 3 then 'not a url' else 'https://api.example.com/v1/models' end as url, "
        "case turn % 4 when 0 then '' when 1 then 'plain text, not JSON' when 2 then '{\"role\": \"' || role || '\", \"n\": [1, {\"note\": \"mail user' || cast(conv_id as string) || '@example.com now\"}]}' else '{\"role\": \"' || role || '\", \"n\": ' || cast(turn as string) || '}' end as body",
    ),
    "chunks": (
        "conversations",
        "conv_id as request_id, turn as seq, case turn % 3 when 0 then 'call' when 1 then 'content' else 'reasoning' end as channel, case when turn % 3 = 0 then cast(turn % 2 as int) end as idx, "
        "case when turn = 0 then 'id-' || cast(conv_id as string) end as id, case when turn % 3 = 0 then 'tool' || cast(turn % 2 as string) end as name, text as args_fragment",
    ),
    "finishes": (
        "conversations",
        "conv_id, turn, case (conv_id + turn) % 9 when 0 then 'stop' when 1 then 'end_turn' when 2 then 'max_tokens' when 3 then 'tool_use' when 4 then 'SAFETY' when 5 then '' when 6 then 'whatever' when 7 then 'cancelled' end as raw, cast(turn % 2 * (conv_id % 3) as bigint) as n_calls",
    ),
    "marked": (
        "conversations",
        "conv_id, turn, case turn % 4 when 0 then '<|channel|>analysis<|message|>  ' || text when 1 then '<|start|>assistant ' || text || '<|end|>' when 2 then '<|channel>final ' || text else text end as text",
    ),
    "payloads": (
        "events",
        "event_id as id, case event_id % 10 when 0 then '{\"action\": \"click\", \"elementId\": ' || cast(event_id as string) || '}' when 1 then '{\"action\": \"click\"}' when 2 then '{\"action\": \"wait\", \"seconds\": ' || cast(event_id % 60 as string) || '}' when 3 then '{\"action\": \"fly\"}' "
        "when 4 then '{\"action\": \"scroll\", \"direction\": \"sideways\"}' when 5 then '{\"action\": \"tab\", \"op\": \"switch\"}' when 6 then '{\"action\": \"type\", \"text\": \"abc\"}' when 7 then '[1, 2]' when 8 then '{\"action\": \"evaluate\", \"code\": \" \"}' else '{\"action\": \"goto\", \"url\": \"example.com\"}' end as payload",
    ),
    "boxes": (
        "lineitem",
        "cast(l_orderkey as bigint) as image_id, cast(l_linenumber as bigint) as box_id, cast(l_partkey % 400 - 50 as double) as x, cast(l_suppkey % 300 - 30 as double) as y, cast(10 + l_orderkey % 90 as double) as w, cast(5 + l_partkey % 70 as double) as h, cast((l_partkey * 37 + l_suppkey * 11) % 1000 as double) / 1000 as score",
    ),
    "images": ("orders", "cast(o_orderkey as bigint) as image_id, cast(320 as bigint) as width, cast(240 as bigint) as height, cast(1 + o_orderkey % 2 as double) as dpr"),
    "anchors": (
        "lineitem",
        "cast(l_orderkey as bigint) as image_id, 16 as stride, cast(l_partkey % 400 as int) as i, cast(l_partkey % 101 as double) / 100 as cls, cast(l_suppkey * 37 % 90 as double) / 80 as obj, cast(l_suppkey % 10 as double) / 10 as dx, cast(l_partkey % 10 as double) / 10 as dy, cast(l_partkey % 7 as double) / 4 as lw, cast(l_suppkey % 5 as double) / 4 as lh",
    ),
    "field_rows": (
        "part",
        "p_partkey as id, case p_partkey % 5 when 0 then 'textarea' when 1 then 'div' else 'input' end as tag, case p_partkey % 7 when 0 then 'password' when 1 then 'EMAIL' when 2 then 'checkbox' when 3 then 'tel' else 'text' end as type, "
        "case p_partkey % 11 when 0 then 'section-pay shipping cc-number' when 1 then 'given-name' when 2 then 'off' when 3 then 'tel-national nonsense' else null end as autocomplete, "
        "case p_partkey % 13 when 0 then 'userEmail' when 1 then 'card_number' when 2 then 'PIN code' when 3 then 'dateOfBirthInput' when 4 then 'enter pin' when 5 then 'E-mail' when 6 then 'first-name' when 7 then 'productName' when 8 then 'aadhaarNumber' when 9 then 'mobile' when 10 then 'security code' when 11 then 'name on card' else 'orderReference' end as label",
    ),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = DERIVED[name]
    rows = table(spark, sf_dir, base)
    if base == "customer":  # its texts are searched
        rows = spread(rows, "c_custkey")
    return rows.selectExpr(*split_columns(columns))


def derived_sql(name: str) -> str:
    base, columns = DERIVED[name]
    return f"(SELECT {columns} FROM {base})"


#: Characters of a piece; a turn has fewer pieces than places between two turns, however long its text.
PIECE_CHARS, TURN_PLACES = 12, 1 << 28
PIECES = f"""conv_id as request_id, turn * {TURN_PLACES} + piece as seq, case turn % 3 when 0 then 'call' when 1 then 'content' else 'reasoning' end as channel, case when turn % 3 = 0 then cast(turn % 2 as int) end as idx,
    case when turn = 0 and piece = 0 then 'id-' || cast(conv_id as string) end as id, case when turn % 3 = 0 and piece = 0 then 'tool' || cast(turn % 2 as string) end as name, substring(text, cast(piece * {PIECE_CHARS} + 1 as int), {PIECE_CHARS}) as args_fragment"""
_COUNT = f"cast(greatest(1, ceil(coalesce(length(text), 0) / {PIECE_CHARS}.0)) as bigint)"


def piece_rows(conversations: DataFrame) -> DataFrame:
    return conversations.selectExpr("conv_id", "turn", "text", f"explode(sequence(cast(0 as bigint), {_COUNT} - 1)) as piece")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of every turn's text, cut into fragments whose ``seq`` follows from turn and piece; a turn without text is one fragment."""
    return piece_rows(table(spark, sf_dir, "conversations")).selectExpr(*split_columns(PIECES))


def pieces_sql() -> str:
    return f"(SELECT {PIECES} FROM (SELECT conv_id, turn, text, unnest(range({_COUNT})) AS piece FROM conversations))"


def split_columns(columns: str) -> list[str]:
    """At commas outside brackets and quotes."""
    out, depth, quoted, part = [], 0, False, ""
    for c in columns:
        quoted ^= c == "'"
        depth += (c in "([") - (c in ")]") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]
