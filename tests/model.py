"""A journal in plain Python: what queries should return, row by row."""

from __future__ import annotations

from tidemark.functions.predicates import And, Cmp, In, IsNull, Not, Or


def holds(p, row: dict) -> bool:
    if isinstance(p, And):
        return all(holds(q, row) for q in p.parts)
    if isinstance(p, Or):
        return any(holds(q, row) for q in p.parts)
    if isinstance(p, Not):
        return not holds(p.part, row)
    x = row[p.column]
    if isinstance(p, IsNull):
        return x is None
    if isinstance(p, In):
        return x in p.values
    if p.op in ("=", "!="):
        return (x == p.value) == (p.op == "=")
    return x is not None and {"<": x < p.value, "<=": x <= p.value, ">": x > p.value, ">=": x >= p.value}[p.op]


def latest(rows: list[dict], key: str) -> list[dict]:
    """Of rows in order the last of each key, in order."""
    return sorted({r[key]: r for r in rows}.values(), key=lambda r: r["timestamp"])


def quotes(n: int = 300, start: int = 0, step: int = 1, nulls: bool = False) -> list[dict]:
    """Rows in order of time: 20 symbols, 5 bids, 20 ask sizes."""
    return [
        {
            "timestamp": start + i * step, "sym": None if nulls and i % 20 == 0 else f"Symbol_{i % 20}", "bid": None if nulls and i % 13 == 0 else float(i % 5), "ask": float(i),
            "bid_size": -i, "ask_size": None if nulls and i % 5 == 0 else i % 20, "mode": None, "ex": None if nulls and i % 20 == 0 else f"Ex_{i % 20}",
        }
        for i in range(n)
    ]


SCHEMA = "timestamp long, sym string, bid double, ask double, bid_size int, ask_size int, mode string, ex string"
