"""Plain definitions that the operators are held against."""

from __future__ import annotations

import re

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text: str | None, k: int) -> set[tuple[str, ...]]:
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]
    if not ws:
        return set()
    return {tuple(ws)} if len(ws) < k else {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def components(nodes, links) -> dict[int, int]:
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def document_components(rows, k: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component), of all pairs."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    by: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    links, seen = [], set()
    for ids in by.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        links.append((a, b))
    comp = components(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def cosine(a, b) -> float:
    a, b = np.array(a, float), np.array(b, float)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
