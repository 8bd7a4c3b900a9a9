"""Plain single-process versions that the operators are compared with."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict


def shingle_set(text: str | None) -> frozenset:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near(docs: dict[int, str | None], percent: int = 85) -> dict[int, tuple[int, int, bool]]:
    sets = {d: shingle_set(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sorted(sets.items()):
        for shingle in s:
            holders[shingle].append(d)
    pairs = {(a, b) for held in holders.values() for i, a in enumerate(held) for b in held[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in docs}


def base_secrets(text: str | None) -> tuple[int, int, int, str]:
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = []
    for rank, (kind, pattern) in enumerate((("assign", assign), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))):
        for m in pattern.finditer(text or ""):
            size = len(m.group(2)) if kind == "assign" else len(m.group())
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                spans.append((m.start(), rank, m.end(), kind))
    count = lambda k: sum(s[3] == k for s in spans)
    told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return count("assign"), count("access"), count("hex"), hashlib.sha256(told.encode()).hexdigest()


def edit_distance_within(item: str, text: str) -> int:
    """Least edit distance between the item and any substring of the text, by the full table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for ch in text:
        before, row[0] = row[0], 0
        for i, c in enumerate(item, 1):
            before, row[i] = row[i], min(before + (c != ch), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def pieces(ids: list[int], capacity: int = 2048) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of one document, its end id included."""
    n = -(-len(ids) // capacity)
    first = len(ids) - (n - 1) * capacity
    edges = [0, *(first + capacity * i for i in range(n))]
    return [(a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))) for a, b in zip(edges, edges[1:])]


def removed_bytes(texts: dict[int, bytes], size: int = 100) -> dict[int, bytearray]:
    """By document, 1 for each byte covered by a string of ``size`` bytes that also starts earlier."""
    seen, out = set(), {}
    for d in sorted(texts):
        b = texts[d]
        mask = bytearray(len(b))
        for i in range(len(b) - size + 1):
            window = b[i : i + size]
            if window in seen:
                mask[i : i + size] = b"\x01" * size
            else:
                seen.add(window)
        out[d] = mask
    return out


def top_k(vectors: dict[int, list[float]], k: int = 20, every: int = 20) -> set[tuple[int, int, int, int]]:
    import math

    whole = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items()}
    out = set()
    for q, v in whole.items():
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q)[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)}
    return out
