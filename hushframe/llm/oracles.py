"""DuckDB SQL for the corpus queries that SQL can state over whole tables."""

from __future__ import annotations

from .archives import MIN_REVISIT_BYTES
from .covertree import ENTRIES, PARTS, ROUNDS, SCALE
from .linededup import LOWER, MIN_CHARS, MIN_DOCS, UPPER
from .quality import MAX_HOST_RATE, MAX_REPEAT_PERCENT, MIN_WORDS
from .recompression import WINDOW

WORD = r"[^\x20\x09-\x0D]+"
BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
EMPTY = "sha256('')"


def words(table: str, key: str, text: str, pattern: str) -> str:
    """``key, i, word, n``: words in order, from 1, and their number."""
    return f"(SELECT {key}, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS ws FROM {table}))"


def windows(source: str, size: int) -> str:
    """Adds ``h``, the window of ``size`` words that starts at each, null where the text ends before."""
    return f"(SELECT *, CASE WHEN i + {size - 1} <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) END AS h FROM {source})"


def covering(flag: str, size: int) -> str:
    return f"coalesce(max(CASE WHEN {flag} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW), 0)"


QUALITY = f"""WITH w AS {windows(words('documents', 'doc_id', "coalesce(text, '')", WORD), 3)},
    often AS (SELECT doc_id, h FROM w WHERE h IS NOT NULL GROUP BY doc_id, h HAVING count(*) > 1),
    r AS (SELECT w.doc_id, word, {covering('often.h IS NOT NULL', 3).replace('doc_id ORDER', 'w.doc_id ORDER')} AS again FROM w LEFT JOIN often ON w.doc_id = often.doc_id AND w.h = often.h),
    s AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(again) AS n_repeat_words FROM r GROUP BY doc_id),
    l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
    b AS (SELECT d.doc_id, d.source, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN dup USING (doc_id)),
    f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
    host AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM f GROUP BY source),
    total AS (SELECT sum(n) AS docs, count(*) AS hosts, sum(bad) / sum(n) AS mean FROM host),
    spread AS (SELECT any_value(mean) AS mean, any_value(mean * (1 - mean)) AS within, sum(n * pow(bad / n - mean, 2)) / any_value(docs) - any_value(mean * (1 - mean) * hosts / docs) AS between_ FROM host, total),
    prior AS (SELECT mean, CASE WHEN between_ > 0 THEN least(greatest(within / between_ - 1, 2.0), 1000.0) ELSE 1000.0 END AS strength FROM spread),
    judged AS (SELECT source, source IS NOT NULL AND (bad + mean * strength) / (n + strength) >= {MAX_HOST_RATE} AS rejected FROM host, prior)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM f JOIN judged ON f.source IS NOT DISTINCT FROM judged.source"""

_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
DECONTAMINATION = f"""WITH item AS {words('benchmark WHERE text IS NOT NULL', 'item_id', _LOWERED, BENCH_WORD)},
    phrase AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(n, 13) AS size, string_agg(word, ' ') OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS h, i, n FROM item),
    p AS (SELECT DISTINCT item, size, h FROM phrase WHERE i + size - 1 <= n),
    w AS {words('documents', 'doc_id', _LOWERED, BENCH_WORD)},
    whole AS (SELECT doc_id, list(word ORDER BY i) AS ws FROM w GROUP BY doc_id),
    starts AS (SELECT doc_id, i, n FROM w SEMI JOIN (SELECT DISTINCT string_split(h, ' ')[1] AS word FROM p) USING (word)),
    tried AS (SELECT s.doc_id, i, size, array_to_string(ws[i : i + size - 1], ' ') AS h FROM starts s JOIN whole USING (doc_id), (SELECT DISTINCT size FROM p) WHERE i + size - 1 <= n),
    hit AS (SELECT doc_id, i, size, item FROM tried JOIN p USING (size, h)),
    hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hit GROUP BY doc_id),
    counts AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, {EMPTY}) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) AS contaminated FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)"""

LINES = f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
    often AS (SELECT key FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
    SELECT doc_id, count(*) AS n_lines, count(often.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often.key IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN often ON k.key = often.key GROUP BY doc_id"""

WORD_WINDOWS = f"""WITH x AS {windows(words('documents', 'doc_id', "coalesce(text, '')", WORD), WINDOW)},
    m AS (SELECT h, min(doc_id) AS least FROM x WHERE h IS NOT NULL GROUP BY h),
    c AS (SELECT x.doc_id, i, word, {covering('least < x.doc_id', WINDOW).replace('doc_id ORDER', 'x.doc_id ORDER')} AS gone FROM x LEFT JOIN m ON x.h = m.h),
    s AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256 FROM c GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(kept_sha256, {EMPTY}) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)"""

#: Bytes as pairs of hexadecimal digits.
BYTE_WINDOWS = f"""WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
    u AS (SELECT doc_id, x, length(x) // 2 AS n, unnest(range(length(x) // 2)) AS i FROM t),
    w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS b, CASE WHEN i + 50 <= n THEN substr(x, 2 * i + 1, 100) END AS h FROM u),
    m AS (SELECT h, min(doc_id) AS least FROM w WHERE h IS NOT NULL GROUP BY h),
    c AS (SELECT w.doc_id, i, b, {covering('least < w.doc_id', 50).replace('doc_id ORDER', 'w.doc_id ORDER')} AS gone FROM w LEFT JOIN m ON w.h = m.h),
    r AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM c),
    s AS (SELECT doc_id, count(*) AS n_bytes, sum(gone) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans, sha256(unhex(coalesce(string_agg(b, '' ORDER BY i) FILTER (gone = 0), ''))) AS kept_sha256 FROM r GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(kept_sha256, {EMPTY}) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)"""

ARCHIVES = f"""WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    row_number() OVER same AS place, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest FROM pages WINDOW same AS (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST)),
    r AS (SELECT *, payload_bytes >= {MIN_REVISIT_BYTES} AND place > 1 AS again FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN newest END AS refers_to FROM r"""


def floored(total: str, n: str) -> str:
    """Exact floor of a quotient of whole numbers, ``n`` above 0."""
    return f"(({total}) - ((({total}) % ({n})) + ({n})) % ({n})) // ({n})"


def vector_codes(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Lloyd's rounds over whole numbers, one step after the other."""
    d = "(SELECT max(len(embedding)) FROM kept)"
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS nth FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
        x AS MATERIALIZED (SELECT nth, i // ({d} // {parts}) AS part, i % ({d} // {parts}) AS pos, CAST(floor(CAST({SCALE} AS DOUBLE) * v) AS BIGINT) AS x FROM (SELECT nth, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM kept)),
        c0 AS MATERIALIZED (SELECT part, nth - 1 AS entry, pos, x FROM x WHERE nth <= {entries})"""]

    def nearest(book: str) -> str:
        return f"""(SELECT nth, part, arg_min(entry, (apart, entry)) AS entry, min(apart) AS apart FROM (SELECT nth, x.part, entry, sum((x.x - c.x) * (x.x - c.x)) AS apart FROM x JOIN {book} c ON x.part = c.part AND x.pos = c.pos GROUP BY ALL) GROUP BY nth, part)"""

    for k in range(rounds):
        steps.append(f"""a{k} AS MATERIALIZED {nearest(f'c{k}')},
            m{k} AS (SELECT part, entry, pos, sum(x) AS total, count(*) AS n FROM x JOIN a{k} USING (nth, part) GROUP BY ALL),
            c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, CAST(coalesce({floored('total', 'n')}, c.x) AS BIGINT) AS x FROM c{k} c LEFT JOIN m{k} USING (part, entry, pos))""")
    last = f"c{rounds}"
    steps.append(f"""f AS (SELECT nth, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(apart) AS BIGINT) AS error FROM {nearest(last)} GROUP BY nth),
        digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM {last})""")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN kept USING (nth), digest"


ORACLES = {
    "op2_quality_rules": QUALITY,
    "op3_decontaminate": DECONTAMINATION,
    "op6_line_dedup": LINES,
    "op9_suffix_dedup": BYTE_WINDOWS,
    "op10_recompression": WORD_WINDOWS,
    "op11_archives": ARCHIVES,
    "op12_vector_codes": vector_codes(),
}
