"""Logical steps of a query, in the order in which they were asked for."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.predicates import Predicate


@dataclass(frozen=True)
class Where:
    predicate: Predicate


@dataclass(frozen=True)
class Latest:
    """The last row of each key. ``split``: an OR asked for before is split into branches of their own time ranges."""

    key: str
    split: bool = False


@dataclass(frozen=True)
class Sort:
    """Columns and whether each descends."""

    keys: tuple[tuple[str, bool], ...]


@dataclass(frozen=True)
class Reverse:
    pass


@dataclass(frozen=True)
class Take:
    n: int


@dataclass(frozen=True)
class Skip:
    n: int


@dataclass(frozen=True)
class Project:
    """Columns and the names they get."""

    columns: tuple[tuple[str, str], ...]


Step = Where | Latest | Sort | Reverse | Take | Skip | Project
