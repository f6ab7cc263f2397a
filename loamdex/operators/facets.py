"""Counts by value, field overviews and statistics; each is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.errors import TypeMismatch, UnknownField
from loamdex.schema import Schema

_TIMES = {"created": "created_at", "updated": "updated_at"}


def _values(schema: Schema, name: str) -> Column:
    column = F.col(schema.column(name))
    return F.array_distinct(column) if schema[name].is_array else F.when(column.isNotNull(), F.array(column))


def facet(items: DataFrame, schema: Schema, name: str, top: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(value, count): items by value of a keyword field, most first, ties by value.

    known (field, value): values that have been seen; those without an item count 0. They are for global facets only.
    """
    field = schema.get(name)
    if field is None:
        raise UnknownField(name)
    if field.kind != "keyword":
        raise TypeMismatch(f"{name} is a {field.kind} field, not a keyword")
    counts = items.select(F.explode(_values(schema, name)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    if known is not None:
        zero = known.filter(F.col("field") == name).select("value", F.lit(0).cast("long").alias("count"))
        counts = counts.unionByName(zero).groupBy("value").agg(F.max("count").alias("count"))
    counts = counts.orderBy(F.desc("count"), F.asc("value"))
    return counts if top is None else counts.limit(top)


def overview(items: DataFrame, schema: Schema) -> DataFrame:
    """(field, type, doc_count, weight) of every field in order of name; all counts come from one pass."""
    def present(n: str) -> Column:
        column = F.col(schema.column(n))
        return F.size(column) > 0 if schema[n].is_array else column.isNotNull()

    counts = items.agg(*[F.count(F.when(present(n), 1)).alias(n) for n in schema.fields])
    weights = dict(schema.text_fields)
    rows = [
        F.struct(F.lit(n).alias("field"), F.lit(f.kind.capitalize()).alias("type"), F.col(n).alias("doc_count"), F.lit(weights.get(n)).cast("double").alias("weight"))
        for n, f in schema.fields.items()
    ]
    return counts.select(F.inline(F.array(*rows)))


def stats(items: DataFrame, schema: Schema, name: str, scoped: bool, median: bool = False) -> DataFrame:
    """One row: count, min, max, avg, and median if asked for.

    created and updated count items. A field's global count is of values, its scoped count of items that have one.
    """
    if name in _TIMES:
        flat, count = items.select(F.col(_TIMES[name]).alias("x"), "item_id"), F.count(F.lit(1))
    else:
        field = schema.get(name)
        if field is None:
            raise UnknownField(name)
        if field.kind not in ("number", "date"):
            raise TypeMismatch(f"{name} is a {field.kind} field: only numbers and dates have statistics")
        flat = items.select("item_id", F.explode(_values(schema, name)).alias("x"))
        count = F.count_distinct("item_id") if scoped else F.count(F.lit(1))
    more = [F.percentile_approx("x", 0.5).cast("double").alias("median")] if median else []
    return flat.agg(count.alias("count"), F.min("x").cast("double").alias("min"), F.max("x").cast("double").alias("max"), F.avg("x").alias("avg"), *more)
