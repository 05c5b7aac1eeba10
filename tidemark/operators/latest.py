"""The last row of each key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import UnsupportedQueryError


def _check(df: DataFrame, key: str) -> None:
    if isinstance(df.schema[key].dataType, T.BinaryType):
        raise UnsupportedQueryError(f"LATEST BY [{key}]: binary columns can't be keys")


def latest_by(df: DataFrame, key: str, order_key: tuple[str, ...]) -> DataFrame:
    """Of each value of ``key``, null included, the row that is greatest by ``order_key``.

    row_number() = 1 keeps one row of each key and task before the shuffle, so a hot key moves no more
    rows than a rare one.
    """
    _check(df, key)
    w = Window.partitionBy(f"`{key}`").orderBy(*[F.desc(f"`{c}`") for c in order_key])
    return df.withColumn("_latest", F.row_number().over(w)).where("_latest = 1").drop("_latest")


def latest_by_each(df: DataFrame, key: str, order_key: tuple[str, ...], alternatives: list[tuple[Column, Column]]) -> DataFrame:
    """For each (among, keep): of each value of ``key`` the last of the rows that meet ``among``, if it meets ``keep``; a row once.

    One scan and one shuffle, of a row for each key, task and alternative, however many alternatives there are.
    """
    _check(df, key)
    cols = [F.col(f"`{c}`") for c in df.columns]
    row, order = F.struct(*cols), F.struct(*[F.col(f"`{c}`") for c in order_key])
    last = [F.max_by(F.when(among, row), F.when(among, order)).alias(f"_last{i}") for i, (among, _) in enumerate(alternatives)]
    each = df.groupBy(F.col(f"`{key}`")).agg(*last)
    each = each.select(F.col(f"`{key}`"), F.posexplode(F.array(*[F.col(f"_last{i}") for i in range(len(last))])).alias("_at", "_row_of")).where("_row_of is not null")
    each = each.select("_at", *[F.col(f"`{c}`") if c == key else F.col(f"_row_of.`{c}`").alias(c) for c in df.columns])
    fits = reduce(lambda a, b: a | b, [(F.col("_at") == i) & keep for i, (_, keep) in enumerate(alternatives)])
    return each.where(fits).drop("_at").dropDuplicates(list(dict.fromkeys([key, *order_key])))
