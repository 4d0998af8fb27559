"""Brute-force versions of the operators, and awkward inputs shared by their tests."""
from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import combinations

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def awkward_texts() -> list[tuple]:
    """Null and empty texts, repeated rows, a null id, a very long text and a very long word, odd white space."""
    base = " ".join(f"word{i % 37}x{i % 11}" for i in range(60))
    return [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n "), (None, base), (6, base + " tail"), (7, "One two"), (8, "one TWO"),
            (9, " ".join(f"t{i}" for i in range(30_000))), (10, "x" * 100_000), (11, "a\x0bb\x0cc d e"), (12, base.upper())]


def shingles(text: str | None, k: int) -> frozenset:
    w = SPACED.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_classes(rows, k, num, den) -> dict:
    """doc_id -> smallest doc_id reachable by links; rows with distinct ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: find(i) for i in sets}


def without_repeats(rows, window) -> dict:
    """doc_id -> (words, removed, sha256 of the kept words); rows with distinct ids."""
    first: dict = defaultdict(lambda: 1 << 62)
    tokens = {i: SPACED.findall(t or "") for i, t in rows}
    for i, w in tokens.items():
        for j in range(len(w) - window + 1):
            first[tuple(w[j:j + window])] = min(i, first[tuple(w[j:j + window])])
    out = {}
    for i, w in tokens.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < i:
                gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def contaminated(rows, items, window) -> list:
    """Per row: (words, hit words, sorted ids of the items found)."""
    wins = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            wins[tuple(w[j:j + k])].add("null" if item is None else str(item))
    out = []
    for _, t in rows:
        w, hit, found = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k]) in wins:
                    hit.update(range(j, j + k))
                    found |= wins[tuple(w[j:j + k])]
        out.append((len(w), len(hit), sorted(found)))
    return out
