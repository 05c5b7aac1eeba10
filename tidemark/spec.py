"""What makes a table a journal: its timestamp, the order of rows with equal ones, and its partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import QueryError

PARTITION_FORMATS = {"DAY": "yyyy-MM-dd", "MONTH": "yyyy-MM", "YEAR": "yyyy", "NONE": None}

#: Field types of a journal and the Spark types that hold them. Bytes are unsigned, so they need a short.
FIELD_TYPES = {
    "Byte": T.ShortType(), "Bool": T.BooleanType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(), "Double": T.DoubleType(),
    "String": T.StringType(), "Symbol": T.StringType(), "Binary": T.BinaryType(), "DateTime": T.TimestampNTZType(), "DateTimeEpochMs": T.TimestampNTZType(),
}


def schema_of(**fields: str) -> T.StructType:
    """A schema from field types by name; a trailing ``?`` makes a field nullable."""
    out = T.StructType()
    for name, kind in fields.items():
        if kind.rstrip("?") not in FIELD_TYPES:
            raise QueryError(f"Unsupported field type {kind} of {name}")
        out.add(name, FIELD_TYPES[kind.rstrip("?")], kind.endswith("?") or kind.rstrip("?") in ("String", "Symbol", "Binary"))
    return out


@dataclass(frozen=True)
class JournalSpec:
    """``timestamp`` orders rows; ``tiebreak`` columns order rows of one timestamp and, with it, identify a row."""

    name: str
    timestamp: str | None = None
    tiebreak: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()
    partition_by: str = "NONE"

    def __post_init__(self) -> None:
        if self.partition_by.upper() not in PARTITION_FORMATS:
            raise QueryError(f"Unknown partition unit {self.partition_by}")
        if self.timestamp is None and self.partition_by.upper() != "NONE":
            raise QueryError("A journal without a timestamp can't be partitioned")

    @property
    def order_key(self) -> tuple[str, ...]:
        return ((self.timestamp,) if self.timestamp else ()) + self.tiebreak
