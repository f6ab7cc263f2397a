"""One document: exact bytes, ranges of metadata and body, and what is wrong with it."""

from __future__ import annotations

import bisect
import functools
import re
from dataclasses import dataclass, field

from loamdex.okf.yamltree import Node, YamlError, metadata

_HEAD = re.compile(r"(?P<mark>\ufeff)?(?P<first>[^\n]*?)(?P<end>\r?\n|\Z)")
_CLOSE = re.compile(r"^---(?:\r?\n|\Z)", re.M)
# Fixed values of the format: recognised top-level keys.
RECOGNISED = (
    "type", "title", "description", "resource", "tags", "timestamp", "status", "stale_after", "sources", "usage_window", "generated", "verified",
    "runtime", "parameters", "computation", "executor", "attester", "okf_version",
)


@dataclass(frozen=True)
class Finding:
    severity: str
    code: str
    path: str
    line: int | None
    column: int | None
    section: str
    message: str


@dataclass
class Document:
    """text is None where the bytes are no UTF-8; body_at counts characters of the text."""

    path: str
    raw: bytes
    text: str | None = None
    metadata: Node | None = None
    body: str | None = None
    body_at: int = 0
    findings: list[Finding] = field(default_factory=list)

    def say(self, code: str, message: str, at: Node | tuple[int, int] | None, section: str, severity: str = "warning") -> None:
        place = (at.line, at.column) if isinstance(at, Node) else at or (None, None)
        self.findings.append(Finding(severity, code, self.path, *place, section, message))

    @functools.cached_property
    def _starts(self) -> list[int]:
        return [0, *(m.end() for m in re.finditer("\n", self.text or ""))]

    def place(self, offset: int) -> tuple[int, int]:
        """Line and column of a character offset in the body."""
        at = self.body_at + offset
        line = bisect.bisect_right(self._starts, at)
        return line, at - self._starts[line - 1] + 1


def opened(path: str, raw: bytes, what: str) -> Document:
    """The document with its text, or with what is said of bytes that are no UTF-8."""
    doc = Document(path, raw)
    try:
        doc.text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        *lines, last = raw[: e.start].decode("utf-8").split("\n")
        doc.say("OKF100", f"the {what} is not UTF-8", (len(lines) + 1, len(last) + 1), "4.1", "error")
    return doc


def parse_document(path: str, raw: bytes) -> Document:
    """Split into metadata and body without changing a byte; never raises for what a document holds."""
    doc = opened(path, raw, "document")
    if doc.text is None:
        return doc
    head = _HEAD.match(doc.text)
    first, close = head["first"], _CLOSE.search(doc.text, head.end()) if head["end"] else None
    fenced = first.strip() == "---"
    # what holds of the two delimiters; each is said at the top of the document
    for code, said, message, severity in (
        ("OKF107", head["mark"] is not None, "the document starts with a byte-order mark", "warning"),
        ("OKF101", not fenced, "no opening delimiter of the metadata", "error"),
        ("OKF108", fenced and first != "---", "white space around the opening delimiter", "warning"),
        ("OKF102", fenced and close is None, "no closing delimiter of the metadata", "error"),
    ):
        if said:
            doc.say(code, message, (1, 1), "4.1", severity)
    if fenced and close is not None:
        doc.body_at, doc.body = close.end(), doc.text[close.end() :]
        _interpret(doc, doc.text[head.end() : close.start()])
    return doc


def _interpret(doc: Document, source: str) -> None:
    try:
        doc.metadata, repeated = metadata(source)
    except YamlError as e:
        return doc.say(e.code, e.message, (e.line, e.column), "4.1", "error")
    for key, node in repeated:
        if key in RECOGNISED:
            doc.say("OKF106", f"key {key!r} is given more than once; the first counts", node, "4.1")
