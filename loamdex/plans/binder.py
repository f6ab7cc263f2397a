"""Query tree to one boolean column over the wide items row.

A leaf is null where a field is absent. Null counts as false in a filter, and AND and OR keep it so, which leaves plain
comparisons that can be pushed to the scan; under NOT it is made false, so NOT is the complement over all items.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamdex.errors import QueryRejected, TypeMismatch, UnknownField
from loamdex.functions import patterns, text
from loamdex.plans import ast
from loamdex.plans.parser import UNIT_MS, date_ms
from loamdex.schema import Schema

_TIMES = {"created": "created_at", "updated": "updated_at"}
_COMPARE = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


@dataclass
class Bound:
    """The test for a filter, what it does in words, and the phrases that count for ranking as (field, tokens)."""

    test: Column
    steps: list[str]
    phrases: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    #: (fields, tokens): every match holds each of the tokens in one of the fields.
    required: list[tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=list)

    @property
    def condition(self) -> Column:
        """The test as true or false, never null."""
        return F.coalesce(self.test, F.lit(False))


class Binder:
    def __init__(self, schema: Schema, now_ms: int):
        self.schema, self.now_ms = schema, now_ms
        self.steps: list[str] = []
        self.phrases: list[tuple[str, tuple[str, ...]]] = []

    def bind(self, tree: ast.Node) -> Bound:
        return Bound(self._node(tree, False), self.steps, list(dict.fromkeys(self.phrases)), self._required(tree))

    def _required(self, node: ast.Node) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
        """The text leaves that all matches satisfy: those under AND alone."""
        if isinstance(node, ast.And):
            return self._required(node.left) + self._required(node.right)
        if isinstance(node, ast.Text):
            names, term = tuple([node.field] if node.field else [n for n, _ in self.schema.text_fields]), node.term
        elif isinstance(node, ast.Keyword) and node.field in self.schema.fields and self.schema[node.field].kind == "text":
            names, term = (node.field,), node.pattern
        else:
            return []
        tokens = tuple(dict.fromkeys(text.term_tokens(term)))
        return [(names, tokens)] if tokens else []

    def _node(self, node: ast.Node, negated: bool) -> Column:
        if isinstance(node, ast.And):
            return self._node(node.left, negated) & self._node(node.right, negated)
        if isinstance(node, ast.Or):
            return self._node(node.left, negated) | self._node(node.right, negated)
        if isinstance(node, ast.Not):
            return ~F.coalesce(self._node(node.inner, True), F.lit(False))
        leaf = getattr(self, f"_{type(node).__name__.lower()}")
        self.steps.append(f"{'exclude' if negated else 'match'} {node}")
        self.negated = negated
        return leaf(node)

    def _field(self, name: str):
        found = self.schema.get(name)
        if found is None:
            raise UnknownField(name)
        return found

    def _any(self, name: str, test) -> Column:
        column = F.col(self.schema.column(name))
        return F.exists(column, test) if self.schema[name].is_array else test(column)

    def _has(self, node: ast.Has) -> Column:
        column = F.col(self.schema.column(node.field)) if self._field(node.field) else None
        return F.size(column) > 0 if self.schema[node.field].is_array else column.isNotNull()

    def _path(self, node: ast.Path) -> Column:
        path, pattern = F.col("path"), node.pattern
        if pattern.count("*") == 1 and pattern.endswith("*") and "?" not in pattern:
            return patterns.like(path, pattern[:-1] + "%")
        return patterns.glob(path, pattern)

    def _keyword(self, node: ast.Keyword) -> Column:
        name, pattern = node.field, node.pattern
        if name in _TIMES:
            ms = date_ms(pattern)
            if node.shape != "exact" or ms is None:
                raise TypeMismatch(f"{name} is compared with dates")
            return F.col(_TIMES[name]) == ms
        kind = self._field(name).kind
        if kind == "text":
            return self._term([name], pattern)
        if kind == "bool" and node.shape == "exact" and pattern in ("true", "false"):
            return self._bool(ast.Bool(name, pattern == "true"))
        if kind == "date" and node.shape == "exact":
            if (ms := date_ms(pattern)) is None:
                raise TypeMismatch(f"{name} is a date, {pattern!r} is none")
            return self._any(name, lambda x: x == ms)
        if kind != "keyword":
            raise TypeMismatch(f"{name} is a {kind} field, {pattern!r} does not fit it")
        if node.shape == "exact":
            column = F.col(self.schema.column(name))
            return F.array_contains(column, pattern) if self.schema[name].is_array else column == F.lit(pattern)
        if node.shape == "glob":
            return self._any(name, lambda x: patterns.glob(x, pattern))
        wild = pattern[:-1] + "%" if node.shape == "prefix" else f"%{pattern[1:-1]}%"
        return self._any(name, lambda x: patterns.like(x, wild))

    def _text(self, node: ast.Text) -> Column:
        if node.field is not None:
            return self._term([node.field], node.term)
        names = [n for n, _ in self.schema.text_fields]
        if not names:
            raise QueryRejected("the schema has no text fields")
        return self._term(names, node.term)

    def _term(self, names: list[str], term: str) -> Column:
        phrase = text.term_tokens(term)
        if not self.negated and phrase:
            self.phrases += [(n, tuple(phrase)) for n in names]
        tests = [text.holds(F.col(self.schema.tokens(n)), phrase) for n in names]
        return functools.reduce(operator.or_, [F.coalesce(t, F.lit(False)) for t in tests])

    def _numeric(self, name: str) -> None:
        if (kind := self._field(name).kind) != "number":
            raise TypeMismatch(f"{name} is a {kind} field, not a number")

    def _number(self, node: ast.Number) -> Column:
        self._numeric(node.field)
        return self._any(node.field, lambda x: _COMPARE[node.op](x, F.lit(node.value)))

    def _numberrange(self, node: ast.NumberRange) -> Column:
        self._numeric(node.field)
        return self._any(node.field, lambda x: (x >= F.lit(node.low)) & (x <= F.lit(node.high)))

    def _dated(self, name: str, test) -> Column:
        if name in _TIMES:
            return test(F.col(_TIMES[name]))
        if (kind := self._field(name).kind) != "date":
            raise TypeMismatch(f"{name} is a {kind} field, not a date")
        return self._any(name, test)

    def _date(self, node: ast.Date) -> Column:
        return self._dated(node.field, lambda x: _COMPARE[node.op](x, F.lit(node.ms)))

    def _daterange(self, node: ast.DateRange) -> Column:
        return self._dated(node.field, lambda x: (x >= F.lit(node.low)) & (x <= F.lit(node.high)))

    def _daterelative(self, node: ast.DateRelative) -> Column:
        span = node.amount * UNIT_MS[node.unit]
        if node.field in _TIMES:
            # an age: younger than a span means at or after now less the span
            edge = F.lit(self.now_ms - span)
            column = F.col(_TIMES[node.field])
            return column >= edge if node.op.startswith("<") else column <= edge
        return self._dated(node.field, lambda x: _COMPARE[node.op](x, F.lit(self.now_ms + span)))

    def _bool(self, node: ast.Bool) -> Column:
        if (kind := self._field(node.field).kind) != "bool":
            raise TypeMismatch(f"{node.field} is a {kind} field, not a bool")
        return F.col(self.schema.column(node.field)) == F.lit(node.value)


