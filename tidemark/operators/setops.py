"""Set operations on query results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import QueryError


def same_rows(a: DataFrame, b: DataFrame, row_key: tuple[str, ...]) -> DataFrame:
    """Rows of either of two queries over one journal, each once, told apart by ``row_key``."""
    return a.unionByName(b).dropDuplicates(list(row_key) or None)


def compound(op: str, a: DataFrame, b: DataFrame) -> DataFrame:
    if len(a.columns) != len(b.columns):
        raise QueryError(f"{op} of {len(a.columns)} and {len(b.columns)} columns")
    b = b.toDF(*a.columns)
    return {"UNION ALL": a.union, "UNION": lambda x: a.union(x).distinct(), "INTERSECT": a.intersect, "EXCEPT": a.subtract}[op](b)
