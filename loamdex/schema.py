"""Fields of an index and the Spark columns that hold them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import types as T

from loamdex.errors import SchemaError

# The names and kinds that the data model has.
KINDS = ("keyword", "text", "number", "date", "bool")
IMPLICIT = ("path", "created", "updated")
#: Columns that every row has; created and updated are queried by their short names.
#: length counts the tokens of all text fields.
BASE = "item_id LONG, path STRING, data_json STRING, created_at LONG, updated_at LONG, length LONG"

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*").fullmatch


@dataclass(frozen=True)
class Field:
    kind: str
    multi: bool = False
    weight: float | None = None

    @property
    def spark_type(self) -> T.DataType:
        one = {"keyword": T.StringType(), "text": T.StringType(), "number": T.DoubleType(), "date": T.LongType(), "bool": T.BooleanType()}[self.kind]
        return T.ArrayType(one) if self.multi and self.kind in ("keyword", "number", "date") else one

    @property
    def is_array(self) -> bool:
        return isinstance(self.spark_type, T.ArrayType)


class Schema:
    """Named fields in order of name. Column names are prefixed, so no field can hide a base column."""

    def __init__(self, fields: dict[str, Field]):
        if not fields:
            raise SchemaError("a schema needs at least one field")
        for name, field in fields.items():
            if not _NAME(name):
                raise SchemaError(f"invalid field name {name!r}")
            if name in IMPLICIT:
                raise SchemaError(f"field name {name!r} is reserved")
            if field.kind not in KINDS:
                raise SchemaError(f"field {name!r} has unknown type {field.kind!r}")
            if field.weight is not None and (field.kind != "text" or not field.weight > 0):
                raise SchemaError(f"field {name!r}: only text fields have a weight, which is above 0")
        self.fields = dict(sorted(fields.items()))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self.fields == other.fields

    def __getitem__(self, name: str) -> Field:
        return self.fields[name]

    def get(self, name: str) -> Field | None:
        return self.fields.get(name)

    @property
    def text_fields(self) -> list[tuple[str, float]]:
        return [(n, 1.0 if f.weight is None else f.weight) for n, f in self.fields.items() if f.kind == "text"]

    @staticmethod
    def column(name: str) -> str:
        return f"f_{name}"

    @staticmethod
    def tokens(name: str) -> str:
        return f"t_{name}"

    def struct(self) -> T.StructType:
        out = T.StructType.fromDDL(BASE)
        for name, field in self.fields.items():
            out = out.add(self.column(name), field.spark_type)
            if field.kind == "text":
                out = out.add(self.tokens(name), T.ArrayType(T.StringType()))
        return out

    def to_json(self) -> str:
        body = {}
        for name, f in self.fields.items():
            body[name] = {"type": f.kind, "multi": f.multi} | ({} if f.weight is None else {"weight": f.weight})
        return json.dumps({"fields": body}, separators=(",", ":"), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Schema:
        try:
            body = json.loads(text)["fields"]
            return cls({n: Field(f["type"], bool(f.get("multi", False)), f.get("weight")) for n, f in body.items()})
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise SchemaError(f"not a schema: {e}") from e

    @classmethod
    def from_spec(cls, spec: str | list[str]) -> Schema:
        """Inline form: name:type[:multi], separated by commas or given one by one; text has weight 1."""
        fields = {}
        for part in spec.split(",") if isinstance(spec, str) else spec:
            name, *rest = part.strip().split(":")
            if not rest or len(rest) > 2 or (len(rest) == 2 and rest[1] != "multi"):
                raise SchemaError(f"expected name:type[:multi], got {part!r}")
            fields[name] = Field(rest[0], len(rest) == 2, 1.0 if rest[0] == "text" else None)
        return cls(fields)

    def check_additive(self, new: Schema) -> list[str]:
        """Names that new adds; raises unless every old field stays with its type and multi. Weights may change."""
        for name, field in self.fields.items():
            other = new.get(name)
            if other is None:
                raise SchemaError(f"field {name!r} is missing from the new schema")
            if (other.kind, other.multi) != (field.kind, field.multi):
                raise SchemaError(f"field {name!r} changes its type or multi")
        return [n for n in new.fields if n not in self.fields]
