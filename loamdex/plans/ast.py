"""The query tree."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    pass


@dataclass(frozen=True)
class And(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Or(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    inner: Node


@dataclass(frozen=True)
class Has(Node):
    field: str


@dataclass(frozen=True)
class Path(Node):
    pattern: str


@dataclass(frozen=True)
class Keyword(Node):
    """shape: exact, prefix, contains or glob."""

    field: str
    pattern: str
    shape: str


@dataclass(frozen=True)
class Text(Node):
    """field None: any text field."""

    field: str | None
    term: str


@dataclass(frozen=True)
class Number(Node):
    field: str
    op: str
    value: float


@dataclass(frozen=True)
class NumberRange(Node):
    field: str
    low: float
    high: float


@dataclass(frozen=True)
class Date(Node):
    field: str
    op: str
    ms: int


@dataclass(frozen=True)
class DateRange(Node):
    field: str
    low: int
    high: int


@dataclass(frozen=True)
class DateRelative(Node):
    field: str
    op: str
    amount: int
    unit: str


@dataclass(frozen=True)
class Bool(Node):
    field: str
    value: bool
