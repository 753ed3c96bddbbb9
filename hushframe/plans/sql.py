"""DuckDB SQL that states the operators' results: patterns, checksums, spans and redaction."""

from __future__ import annotations

import re

from ..functions.detectors import DETECTORS, PAN_HOLDERS
from ..functions.expressions import BLANK as JAVA_BLANK
from ..functions.expressions import EDGE, verhoeff_tables

BLANK = r"[\t\n\x{0B}\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def as_re2(pattern: str) -> str:
    """A detector's pattern in RE2's spelling: its edges are those of ASCII words as they are, and it knows no look-ahead."""
    return re.sub(r"^\(\?=\[[^\]]*\]\)", "", pattern).replace(EDGE, r"\b").replace(JAVA_BLANK, BLANK)


#: The published formats, from the one place that has them.
PATTERNS = {d.kind: as_re2(d.pattern) for d in DETECTORS}
EMAIL = PATTERNS["email"]


def digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '', 'g')"


def luhn(d: str) -> str:
    own = f"(CAST(substr({d}, length({d}) - i, 1) AS INT) * (1 + i % 2))"
    return f"(list_sum(list_transform(range(length({d})), lambda i: {own} - CASE WHEN {own} > 9 THEN 9 ELSE 0 END)) % 10 = 0)"


def verhoeff(d: str) -> str:
    product, power = verhoeff_tables()
    placed = f"list_transform(range(length({d})), lambda i: {power}[i % 8 * 10 + CAST(substr({d}, length({d}) - i, 1) AS INT) + 1])"
    return f"(list_reduce(list_prepend(0, {placed}), lambda a, b: {product}[a * 10 + b + 1]) = 0)"


def pan_ok(t: str) -> str:
    return f"contains('{PAN_HOLDERS}', substr({t}, 4, 1))"


ACCEPT = {
    "email": "true",
    "gstin": f"((CAST(substr(m, 1, 2) AS INT) BETWEEN 1 AND 38 OR CAST(substr(m, 1, 2) AS INT) IN (97, 99)) AND {pan_ok('substr(m, 3, 10)')})",
    "ifsc": "true",
    "pan": pan_ok("m"),
    "cc-number": f"(length({digits('m')}) BETWEEN 13 AND 19 AND {luhn(digits('m'))})",
    "aadhaar": verhoeff(digits("m")),
    "tel": f"(length({digits('m')}) = 10 OR (length({digits('m')}) = 12 AND starts_with({digits('m')}, '91')))",
}


def matches(source: str, key: str, text: str, pattern: str) -> str:
    """``key, s, e, m`` of all matches, with places in code points."""
    return f"""(SELECT {key}, s, s + length(m) AS e, m FROM (SELECT {key}, f[i + 1] AS m,
        CAST(list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i], lambda x: length(x))), 0) AS BIGINT) AS s
        FROM (SELECT {key}, f, g, unnest(range(len(f))) AS i FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS f, string_split_regex({text}, '{pattern}') AS g
        FROM {source} AS src WHERE regexp_matches({text}, '{pattern}')))))"""


def detected(source: str, key: str, text: str, kind: str) -> str:
    return f"(SELECT {key}, s, e, m, '{kind}' AS kind FROM {matches(source, key, text, PATTERNS[kind])} WHERE {ACCEPT[kind]})"


def found_ctes(source: str, key: str, text: str) -> str:
    """CTEs ending in ``found(key, s, e, m, kind)``: all detectors, overlaps resolved from left to right."""
    each = " UNION ALL ".join(f"SELECT *, {rank} AS rank FROM {detected(source, key, text, kind)}" for rank, kind in enumerate(PATTERNS))
    keys = [k.strip() for k in key.split(",")]
    same = " AND ".join(f"n.{k} = w.{k}" for k in keys)
    own = ", ".join(f"n.{k}" for k in keys)
    return f"""WITH RECURSIVE every AS ({each}),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s, e DESC, rank) AS nth FROM every),
        swept AS (SELECT {key}, s, e, m, kind, nth, e AS upto, true AS kept FROM numbered WHERE nth = 1
            UNION ALL SELECT {own}, n.s, n.e, n.m, n.kind, n.nth, CASE WHEN n.s < w.upto THEN w.upto ELSE n.e END, n.s >= w.upto FROM swept w JOIN numbered n ON {same} AND n.nth = w.nth + 1),
        found AS (SELECT {key}, s, e, m, kind FROM swept WHERE kept)"""


def redacted_ctes(source: str, key: str, text: str, marker: str = "'[redacted:' || kind || ']'", more: str = "") -> str:
    """CTEs ending in ``redacted(key, out, kinds)`` for every row of the source; ``marker`` is over ``marked``."""
    return f"""{found_ctes(source, key, text)}, {more or 'marked AS (SELECT * FROM found)'},
        pieces AS (SELECT {key}, s, e, kind, {marker} AS put, coalesce(lag(e) OVER (PARTITION BY {key} ORDER BY s), 0) AS before FROM marked),
        joined AS (SELECT {key}, string_agg(substr(src.{text}, before + 1, s - before) || put, '' ORDER BY s) AS head, max(e) AS upto, string_agg(kind, ',' ORDER BY s) AS kinds FROM pieces JOIN {source} AS src USING ({key}) GROUP BY {key}),
        redacted AS (SELECT {key}, CASE WHEN head IS NULL THEN src.{text} ELSE head || substr(src.{text}, upto + 1) END AS out, coalesce(kinds, '') AS kinds FROM {source} AS src LEFT JOIN joined USING ({key}))"""


def squash(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '{BLANK}+', ' ', 'g'), '^ | $', '', 'g')"
