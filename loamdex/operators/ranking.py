"""Scores, order and keyset positions of a search."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.errors import CursorError, InvalidArgument, TypeMismatch, UnknownField
from loamdex.functions import text
from loamdex.plans.binder import Bound
from loamdex.schema import Schema


@dataclass(frozen=True)
class Rank:
    """default, recency, none, fts_id, or field with a name."""

    mode: str = "default"
    field: str | None = None

    @classmethod
    def of(cls, value: str | Rank) -> Rank:
        if isinstance(value, Rank):
            return value
        if value in ("default", "recency", "none", "fts_id"):
            return cls(value)
        if value.startswith("field:") and value != "field:":
            return cls("field", value.removeprefix("field:"))
        raise InvalidArgument(f"unknown rank {value!r}")

    def key(self) -> Any:
        """What cursors are bound to."""
        return {"Field": self.field} if self.mode == "field" else self.mode.capitalize()


Phrase = tuple[str, ...]


class Corpus:
    """What BM25 needs: rows, mean length, and how many rows hold each phrase in any of the fields that it was asked for.

    known: (rows, tokens) where a store keeps them; held: rows that hold a phrase where an inverted table tells. The rest
    is one aggregation.
    """

    def __init__(self, items: DataFrame, schema: Schema, phrases: dict[Phrase, list[str]], known: tuple[int, int] | None = None, held: Callable[[Phrase, list[str]], int | None] | None = None):
        found = {p: held(p, fields) if held else None for p, fields in phrases.items()}
        open_ = [p for p, n in found.items() if n is None]
        sums = [F.count(F.when(any_holds(schema, p, phrases[p]), 1)).alias(f"n{i}") for i, p in enumerate(open_)]
        if known is None:
            sums += [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")]
        row = items.agg(*sums).first() if sums else None
        self.rows, length = known or (row["rows"], row["length"])
        self.mean = length / self.rows if self.rows else 0.0
        self.holding = found | {p: row[f"n{i}"] for i, p in enumerate(open_)}


def any_holds(schema: Schema, phrase: Phrase, fields: list[str]) -> Column:
    tests = [F.coalesce(text.holds(F.col(schema.tokens(n)), list(phrase)), F.lit(False)) for n in fields]
    return functools.reduce(operator.or_, tests)


def bm25(schema: Schema, phrases: dict[Phrase, list[str]], corpus: Corpus) -> Column:
    """A phrase counts in every field that it was asked for, by the field's weight."""
    weights = dict(schema.text_fields)
    parts = []
    for phrase, fields in phrases.items():
        frequency = F.lit(0.0)
        for name in fields:
            frequency = frequency + F.lit(float(weights[name])) * F.coalesce(text.occurrences(F.col(schema.tokens(name)), list(phrase)), F.lit(0))
        parts.append((frequency, text.idf(corpus.rows, corpus.holding[phrase])))
    return text.bm25(parts, F.col("length"), corpus.mean)


@dataclass
class Order:
    """Sort columns of a search, its score, and how a position continues."""

    kind: str
    score: Column
    sort: list[Column]
    field: str | None = None

    def after(self, payload: dict[str, Any]) -> Column:
        """Rows that come after the position."""
        if payload.get("kind") != self.kind or (self.kind == "field" and payload.get("field") != self.field):
            raise CursorError("the cursor does not belong to this rank")
        score = F.col("score")
        later = lambda c, v: F.col(c) > F.lit(v)
        if self.kind == "none":
            return later("item_id", payload["item_id"])
        if self.kind == "fts":
            s = F.lit(float(payload["score"]))
            return (score < s) | ((score == s) & later("item_id", payload["item_id"]))
        at, path = F.lit(payload["updated_at_ms"]), payload["path"]
        recent = (F.col("updated_at") < at) | ((F.col("updated_at") == at) & later("path", path))
        if self.kind == "recency":
            return recent
        value = F.lit(float(payload["rank_value"]))
        return (score < value) | ((score == value) & recent)

    def payload(self, row: Any) -> dict[str, Any]:
        if self.kind == "none":
            return {"kind": "none", "item_id": row["item_id"]}
        if self.kind == "fts":
            return {"kind": "fts", "score": row["score"], "item_id": row["item_id"]}
        place = {"updated_at_ms": row["updated_at"], "path": row["path"]}
        if self.kind == "recency":
            return {"kind": "recency"} | place
        return {"kind": "field", "field": self.field, "rank_value": row["score"]} | place

    def payload_column(self) -> Column:
        """payload of every row."""
        kind, place = F.lit(self.kind).alias("kind"), [F.col("updated_at").alias("updated_at_ms"), F.col("path")]
        if self.kind == "none":
            return F.struct(kind, F.col("item_id"))
        if self.kind == "fts":
            return F.struct(kind, F.col("score"), F.col("item_id"))
        if self.kind == "recency":
            return F.struct(kind, *place)
        return F.struct(kind, F.lit(self.field).alias("field"), F.col("score").alias("rank_value"), *place)


def order_of(rank: Rank, schema: Schema, bound: Bound, items: DataFrame, **corpus) -> tuple[Order, DataFrame]:
    """The order, and the items that can be ranked: ranking by a field leaves out items without it. corpus: see Corpus."""
    recent = [F.desc("updated_at"), F.asc("path")]
    if rank.mode == "field":
        field = schema.get(rank.field or "")
        if field is None:
            raise UnknownField(rank.field or "")
        if field.kind not in ("number", "date"):
            raise TypeMismatch(f"cannot rank by the {field.kind} field {rank.field}")
        column = F.col(schema.column(rank.field))
        value = (F.array_max(column) if field.is_array else column).cast("double")
        return Order("field", value, [F.desc("score"), *recent], rank.field), items.filter(column.isNotNull())
    if rank.mode in ("none", "fts_id"):
        return Order("none", F.lit(0.0), [F.asc("item_id")]), items
    if rank.mode == "default" and bound.phrases:
        phrases: dict[Phrase, list[str]] = {}
        for name, phrase in bound.phrases:
            phrases.setdefault(phrase, []).append(name)
        score = bm25(schema, phrases, Corpus(items, schema, phrases, **corpus))
        return Order("fts", F.round(score, 9), [F.desc("score"), F.asc("item_id")]), items
    return Order("recency", F.col("updated_at").cast("double"), recent), items
