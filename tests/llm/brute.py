"""Plain versions of the training-data operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return (text or "").encode().lower().decode()


def repeats(rows, passage=50):
    """rows: (doc_id, text) -> [(doc_id, n_words, n_removed, sha256 of kept words)]."""
    first = {}
    for doc, text in rows:
        w = words(text)
        if doc is not None:
            for i in range(len(w) - passage + 1):
                key = tuple(w[i : i + passage])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        if doc is not None:
            for i in range(len(w) - passage + 1):
                if first[tuple(w[i : i + passage])] < doc:
                    gone.update(range(i, i + passage))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, width=5):
    w = words(ascii_lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def near(rows, width=5):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component)}."""
    sets = {d: shingles(t, width) for d, t in rows if d is not None}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets.items():
        for b, n in Counter(d for x in s for d in where[x] if d > a).items():
            if 100 * n >= 75 * (len(s) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}
