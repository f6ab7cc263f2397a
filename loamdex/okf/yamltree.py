"""YAML metadata as nodes with places and kinds; aliases stay shared nodes."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from typing import Any

import yaml

from loamdex.plans.parser import _RFC3339, date_ms

# Explicit tags that name a kind, and the plain words that are not strings.
TAGS = {"str": "string", "timestamp": "timestamp", "bool": "boolean", "int": "integer", "float": "float", "null": "null"}
WORDS = {"": "null", "~": "null", "null": "null", "true": "boolean", "false": "boolean"}
_INT = re.compile(r"[+-]?\d+|0x[0-9a-fA-F]+|0o[0-7]+").fullmatch
_FLOAT = re.compile(r"[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|\.(inf|Inf|INF))|\.(nan|NaN|NAN)").fullmatch
_STAMP = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[Tt ](\d\d):(\d\d):(\d\d)(\.\d*)?(Z|[+-]\d\d(:?\d\d)?)?)?").fullmatch


@dataclass
class Node:
    """kind: a scalar's kind, sequence or mapping. line and column count from 1 in the document."""

    kind: str
    line: int
    column: int
    value: str = ""
    items: list[Any] = field(default_factory=list)

    @property
    def is_scalar(self) -> bool:
        return self.kind not in ("sequence", "mapping")

    @property
    def string(self) -> str | None:
        return self.value if self.kind == "string" else None

    @property
    def date(self) -> str | None:
        return self.value if self.kind in ("string", "timestamp") else None

    def get(self, key: str) -> Node | None:
        """The value of the first such key of a mapping."""
        if self.kind != "mapping":
            return None
        return next((v for k, v in self.items if k.string == key), None)

    def text(self, key: str) -> str | None:
        found = self.get(key)
        return None if found is None else found.string

    def when(self, key: str) -> str | None:
        found = self.get(key)
        return None if found is None else found.date


class _Loader(yaml.SafeLoader):
    """Leaves untagged scalars to scalar_kind."""

    def resolve(self, kind: type, value: str, implicit: Any) -> str:
        if kind is yaml.ScalarNode:
            return "plain" if implicit[0] else "quoted"
        return "collection"


def is_stamp(text: str) -> bool:
    m = _STAMP(text)
    if not m or (m[8] is None and m[4] and text[10:11] != " "):
        return False
    try:
        dt.datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4] or 0), int(m[5] or 0), min(int(m[6] or 0), 59))
    except ValueError:
        return False
    return True


def scalar_kind(tag: str, value: str) -> str:
    if tag == "quoted":
        return "string"
    if tag == "plain":
        if value in WORDS:
            return WORDS[value]
        if _INT(value):
            return "integer"
        if _FLOAT(value):
            return "float"
        return "timestamp" if is_stamp(value) else "string"
    prefix = "tag:yaml.org,2002:"
    return TAGS.get(tag.removeprefix(prefix), "tagged") if tag.startswith(prefix) else "tagged"


class YamlError(Exception):
    def __init__(self, code: str, message: str, line: int, column: int):
        super().__init__(message)
        self.code, self.message, self.line, self.column = code, message, line, column


def metadata(text: str) -> tuple[Node, list[tuple[str, Node]]]:
    """(root mapping, repeated top-level keys) of one YAML document that starts on line 2; else YamlError."""
    try:
        roots = [r for r in yaml.compose_all(text, Loader=_Loader)]
    except yaml.MarkedYAMLError as e:
        mark = e.problem_mark or e.context_mark
        raise YamlError("OKF103", f"not YAML: {e.problem}", (mark.line if mark else 0) + 2, (mark.column if mark else 0) + 1) from e
    except (yaml.YAMLError, RecursionError, ValueError) as e:
        raise YamlError("OKF103", f"not YAML: {e}", 2, 1) from e
    if len(roots) > 1:
        raise YamlError("OKF103", "more than one YAML document", 2, 1)
    if not roots or roots[0] is None or not isinstance(roots[0], yaml.MappingNode):
        mark = roots[0].start_mark if roots and roots[0] is not None else None
        raise YamlError("OKF104", "the root is no mapping", mark.line + 2 if mark else 2, mark.column + 1 if mark else 1)
    made: dict[int, Node] = {}

    def convert(node: yaml.Node) -> Node:
        if id(node) in made:
            return made[id(node)]
        line, column = node.start_mark.line + 2, node.start_mark.column + 1
        if isinstance(node, yaml.ScalarNode):
            out = made[id(node)] = Node(scalar_kind(node.tag, node.value), line, column, node.value)
            return out
        mapping = isinstance(node, yaml.MappingNode)
        out = made[id(node)] = Node("mapping" if mapping else "sequence", line, column)
        out.items = [(convert(k), convert(v)) for k, v in node.value] if mapping else [convert(v) for v in node.value]
        return out

    root = convert(roots[0])
    seen: set[str] = set()
    repeated = []
    for key, _ in root.items:
        if key.string is not None:
            if key.string in seen:
                repeated.append((key.string, key))
            seen.add(key.string)
    return root, repeated


def iso_date(text: str | None) -> bool:
    """YYYY-MM-DD exactly."""
    return text is not None and re.fullmatch(r"\d{4}-\d\d-\d\d", text) is not None and date_ms(text) is not None


def date_time(text: str | None) -> int | None:
    """Milliseconds of an RFC 3339 time."""
    return date_ms(text) if text is not None and _RFC3339(text) else None
