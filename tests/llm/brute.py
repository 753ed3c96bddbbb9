"""Plain versions of the corpus operators, for small tables: rows of (doc_id, text, source)."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def raw(text):
    return (text or "").encode()


def smaller(a, b) -> bool:
    """Whether id a is smaller than id b; no id is larger than any."""
    return a is not None and (b is None or a < b)


def quality(rows):
    out = []
    for i, text, _ in rows:
        data = raw(text)
        words = WORD.findall(data)
        times = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {j + k for j in range(len(words) - 2) if times[tuple(words[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in data.split(b"\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        out.append((i, len(words), sum(len(w.decode()) for w in words), sum(data.count(c) for c in b"#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed))
    return out


def overlap(rows, benchmark):
    windows = {}
    for item, text in benchmark:
        words = BENCH_WORD.findall(raw(text).lower())
        for j in range(max(len(words) - 12, min(len(words), 1))):
            windows.setdefault(tuple(words[j : j + 13]), set()).add(str(item))
    out = []
    for i, text, _ in rows:
        words = BENCH_WORD.findall(raw(text).lower())
        hit, items = set(), set()
        for n in {len(w) for w in windows}:
            for j in range(len(words) - n + 1):
                if found := windows.get(tuple(words[j : j + n])):
                    items |= found
                    hit.update(range(j, j + n))
        out.append((i, len(words), len(hit), len(items), sha(",".join(sorted(items)).encode()), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def fingerprint(text) -> int:
    words = raw(text).lower().split()
    shingles = [b" ".join(words[j : j + 3]) for j in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows):
    prints = [fingerprint(t) for _, t, _ in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                group[root(a)] = root(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        r = root(k)
        if i is not None and (least.get(r) is None or i < least[r]):
            least[r] = i
    return [(i, f"{prints[k]:016x}", least.get(root(k))) for k, (i, _, _) in enumerate(rows)]


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\f\r").lower()


def lines(rows, min_docs=10):
    docs = Counter(k for k, _ in {(line_key(x), i) for i, t, _ in rows if i is not None for x in raw(t).split(b"\n")})
    out = []
    for i, text, _ in rows:
        own = raw(text).split(b"\n")
        left = [x for x in own if not line_key(x) or docs[line_key(x)] < min_docs]
        out.append((i, len(own), len(own) - len(left), sha(b"\n".join(left))))
    return out


def removed(rows, units, size):
    """Per row flags of the units in windows that also start in a row of smaller id."""
    least = {}
    for (i, _, _), own in zip(rows, units, strict=True):
        for j in range(len(own) - size + 1):
            w = own[j : j + size]
            if w not in least or smaller(i, least[w]):
                least[w] = i
    out = []
    for (i, _, _), own in zip(rows, units, strict=True):
        flags = bytearray(len(own))
        for j in range(len(own) - size + 1):
            if smaller(least[own[j : j + size]], i):
                flags[j : j + size] = b"\1" * size
        out.append(bytes(flags))
    return out


def duplicate_bytes(rows):
    units = [raw(t) for _, t, _ in rows]
    return [(i, len(u), sum(f), len(re.findall(b"\1+", f)), sha(bytes(c for c, x in zip(u, f, strict=True) if not x))) for (i, _, _), u, f in zip(rows, units, removed(rows, units, 50), strict=True)]


def duplicate_words(rows):
    units = [tuple(WORD.findall(raw(t))) for _, t, _ in rows]
    return [(i, len(u), sum(f), sha(b" ".join(w for w, x in zip(u, f, strict=True) if not x))) for (i, _, _), u, f in zip(rows, units, removed(rows, units, 50), strict=True)]


def targets(sizes):
    """Target of each source by repeated sharing of what exceeds twice a source's size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = 1.5 * total - sum(2 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        found = {s: 2.0 * sizes[s] if s in full else left * weight[s] / free for s in order}
        over = {s for s in order if s not in full and found[s] > 2 * sizes[s]}
        if not over:
            return found
        full |= over
