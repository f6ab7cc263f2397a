"""What a concept, an index or a log should look like: tables of rules over mappings, and what stands between fields."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from loamdex.okf import markdown
from loamdex.okf.document import Document, opened, parse_document
from loamdex.okf.yamltree import Node, date_time, iso_date

# Fixed values of the format.
VERSION = "0.2"
STATUSES = ("draft", "stable", "deprecated")
COMPUTATION = "Attested Computation"


@dataclass(frozen=True)
class Rule:
    """What a field's value must be. missing: where an absent field is said: nowhere, of the mapping, or without a place."""

    field: str
    code: str
    section: str
    holds: Callable[[Node], bool]
    message: str
    missing: str = "nowhere"
    severity: str = "warning"

    def judge(self, doc: Document, mapping: Node) -> None:
        value = mapping.get(self.field)
        if value is None and self.missing == "nowhere" or value is not None and self.holds(value):
            return
        doc.say(self.code, self.message, value or (mapping if self.missing == "mapping" else None), self.section, self.severity)


def _written(text: str | None) -> bool:
    return bool(text and text.strip())


def actor(text: str) -> bool:
    """kind:name or kind/name, without white space."""
    if not text or re.search(r"\s", text):
        return False
    left, mark, right = text.partition(":") if ":" in text else text.partition("/")
    return bool(left and mark and right)


def _is_string(node: Node) -> bool:
    return node.string is not None


def _is_filled(node: Node) -> bool:
    return _written(node.string)


def _is_date(node: Node) -> bool:
    return iso_date(node.date)


def _is_time(node: Node) -> bool:
    return date_time(node.date) is not None


def _is_strings(node: Node) -> bool:
    return node.kind == "sequence" and all(map(_is_string, node.items))


def _is_receipt(node: Node) -> bool:
    return node.kind == "sequence" and all(map(_is_filled, node.items))


def _is_count(node: Node) -> bool:
    try:
        return node.kind in ("integer", "float") and float(node.value.replace("_", "")) >= 0
    except ValueError:
        return False


def _is_window(node: Node) -> bool:
    days = [node.when("from"), node.when("to")] if node.kind == "mapping" else [None]
    return all(map(iso_date, days)) and days == sorted(days)


def _names_actor(node: Node) -> bool:
    """Of strings that are not blank only; another rule speaks of the rest."""
    return not _written(node.string) or actor(node.string)


def _is_resourceful(node: Node) -> bool:
    return node.kind == "mapping" and _written(node.text("resource"))


def _is_parameter(node: Node) -> bool:
    required = node.get("required")
    return _written(node.text("name")) and _written(node.text("type")) and required is not None and required.kind == "boolean"


_WINDOW = Rule("usage_window", "OKF303", "5.1", _is_window, "usage_window runs from one date to another that is not before it")
CONCEPT = (
    Rule("type", "OKF105", "4.1", _is_filled, "type must be a string that is not blank", "unplaced", "error"),
    Rule("status", "OKF320", "5.4", lambda n: n.string in STATUSES, f"status is one of {', '.join(STATUSES)}"),
    Rule("stale_after", "OKF321", "5.5", _is_date, "stale_after is a date (YYYY-MM-DD)"),
    Rule("tags", "OKF330", "4.1", _is_strings, "tags is a sequence of strings"),
    Rule("generated", "OKF310", "5.2", lambda n: n.kind == "mapping", "generated is a mapping that names by"),
    _WINDOW,
)
SOURCE = (
    Rule("resource", "OKF301", "5.1", _is_filled, "a source needs a resource", "mapping"),
    Rule("id", "OKF300", "5.1", _is_string, "a source's id is a string"),
    Rule("title", "OKF300", "5.1", _is_string, "a source's title is a string"),
    Rule("author", "OKF304", "5.1", _is_string, "a source's author is a string"),
    Rule("author", "OKF314", "7", lambda n: n.string is None or actor(n.string), "a source's author is no actor (kind:name)"),
    Rule("usage_count", "OKF304", "5.1", _is_count, "usage_count is a number of 0 or more"),
    Rule("last_modified", "OKF304", "5.1", _is_date, "last_modified is a date (YYYY-MM-DD)"),
    _WINDOW,
)
GENERATED = (
    Rule("by", "OKF310", "5.2", _is_filled, "generated needs by, an actor", "mapping"),
    Rule("by", "OKF314", "7", _names_actor, "generated.by is no actor (kind:name)"),
    Rule("at", "OKF311", "5.2", _is_time, "generated.at is a time (RFC 3339)"),
)
VERIFIED = (Rule("by", "OKF314", "7", _names_actor, "verified.by is no actor (kind:name)"),)
COMPUTED = (
    Rule("runtime", "OKF350", "10.2", _is_filled, "a computation needs a runtime", "mapping"),
    Rule("parameters", "OKF351", "10.2", lambda n: n.kind == "sequence", "parameters is a sequence"),
    Rule("executor", "OKF353", "10.2", _is_resourceful, "executor is a mapping with a resource"),
    Rule("attester", "OKF354", "10.2", _is_resourceful, "attester is a mapping with a resource"),
)
EXECUTOR = (Rule("receipt", "OKF353", "10.2", _is_receipt, "receipt is a sequence of strings that are not blank"),)


def _apply(doc: Document, mapping: Node | None, rules: Iterable[Rule]) -> None:
    if mapping is not None and mapping.kind == "mapping":
        for rule in rules:
            rule.judge(doc, mapping)


def _entries(doc: Document, node: Node | None, code: str, section: str, lone: str | None = None) -> list[Node]:
    """Mappings of a sequence, or one mapping by itself, of which lone is said."""
    if node is None:
        return []
    several = {"mapping": [node], "sequence": node.items}.get(node.kind)
    if several is None:
        doc.say(code, "expected a sequence of mappings", node, section)
        return []
    if node.kind == "mapping" and lone:
        doc.say(code, lone, node, section)
    for other in (i for i in several if i.kind != "mapping"):
        doc.say(code, "every entry is a mapping", other, section)
    return [i for i in several if i.kind == "mapping"]


def check_concept(doc: Document) -> None:
    """All rules that need nothing but the concept."""
    root, body = doc.metadata, doc.body or ""
    if root is None:
        return
    found = markdown.blocks(body)
    _apply(doc, root, CONCEPT)
    if root.kind != "mapping":
        CONCEPT[0].judge(doc, root)
    sources = _entries(doc, root.get("sources"), "OKF300", "5.1", "expected a sequence; the mapping counts as its one entry")
    for source in sources:
        _apply(doc, source, SOURCE)
    known = _source_ids(doc, sources)
    for offset, label in markdown.footnotes(body, found):
        if label not in known:
            doc.say("OKF360", f"footnote {label!r} has no source of that id", doc.place(offset), "5.1")
    _provenance(doc, root)
    _outdated(doc, root, found)
    if root.text("type") == COMPUTATION:
        _computation(doc, root, found)


def _source_ids(doc: Document, sources: list[Node]) -> Counter[str]:
    used: Counter[str] = Counter()
    for own in (s.get("id") for s in sources):
        name = (own.string or "").strip() if own else ""
        if name and used[name]:
            doc.say("OKF302", f"source id {name!r} is used twice", own, "5.1")
        used.update([name] if name else [])
    return used


def _provenance(doc: Document, root: Node) -> None:
    """generated and verified: who, when, and that no verification is older than what it verifies."""
    made = root.get("generated")
    _apply(doc, made, GENERATED)
    events = _entries(doc, root.get("verified"), "OKF312", "5.2")
    whole = [e for e in events if _written(e.text("by")) and date_time(e.when("at")) is not None]
    for event in events:
        if event in whole:
            _apply(doc, event, VERIFIED)
        else:
            doc.say("OKF313", "a verification needs by and at", event, "5.2")
    written = date_time(made.when("at")) if made is not None else None
    latest = max((date_time(e.when("at")) for e in whole), default=None)
    if written is not None and latest is not None and latest < written:
        doc.say("OKF315", "the last verification is older than generated.at", root.get("verified"), "5.2")


def _outdated(doc: Document, root: Node, found: list[markdown.Block]) -> None:
    if (node := root.get("timestamp")) and root.get("generated") is None:
        doc.say("OKF340", "timestamp is outdated; it stands in for generated.at", node, "13.1")
    cited = [b for b in found if b.kind == "heading" and b.level == 1 and markdown.plain(b.text).strip() == "Citations"]
    for block in cited[:1]:
        doc.say("OKF341", "a Citations section is outdated; it stands in for sources", doc.place(block.start), "13.1")


def _computation(doc: Document, root: Node, found: list[markdown.Block]) -> None:
    _apply(doc, root, COMPUTED)
    parameters = root.get("parameters")
    for item in parameters.items if parameters and parameters.kind == "sequence" else ():
        if not _is_parameter(item):
            doc.say("OKF351", "a parameter has a name, a type and a boolean required", item, "10.2")
    inline = any(b.kind == "code" and b.section == "Computation" for b in found)
    if _written(root.text("computation")) == inline:
        doc.say("OKF352", "a computation is either a file or a code block under its heading", root.get("computation") or root, "10.3")
    if (executor := root.get("executor")) and _is_resourceful(executor):
        _apply(doc, executor, EXECUTOR)


def resources(doc: Document) -> list[tuple[str, str, Node]]:
    """(code, reference, node) of what a computation points to."""
    root = doc.metadata
    if root is None or root.text("type") != COMPUTATION:
        return []
    found = [("OKF352", root.get("computation"))]
    found += [(code, root.get(key).get("resource")) for key, code in (("executor", "OKF353"), ("attester", "OKF354")) if root.get(key) is not None]
    return [(code, node.string, node) for code, node in found if node is not None and node.string]


def check_log(path: str, raw: bytes) -> Document:
    doc = opened(path, raw, "log")
    doc.body = doc.text
    for block in markdown.blocks(doc.body or ""):
        if block.kind == "heading" and block.level == 2 and not iso_date(markdown.plain(block.text).strip()):
            doc.say("OKF203", "a second-level heading of a log is a date (YYYY-MM-DD)", doc.place(block.start), "4.1", "error")
    return doc


def check_index(path: str, raw: bytes) -> tuple[Document, str | None]:
    """Findings of an index, and the version that a root index declares."""
    doc, declared = opened(path, raw, "index"), None
    if doc.text is None:
        return doc, None
    doc.body = doc.text
    if re.match(r"﻿?[^\S\n]*---[^\S\n]*(?:\n|\Z)", doc.text):
        parsed = parse_document(path, raw)
        doc.body, doc.body_at = parsed.body, parsed.body_at
        if path == "index.md":
            doc.findings += parsed.findings
            declared = _version(doc, parsed.metadata)
        else:
            doc.say("OKF200", "only the root index has metadata", (1, 1), "4.1", "error")
    if doc.body is not None:
        _sections(doc, doc.body)
    return doc, declared


def _version(doc: Document, root: Node | None) -> str | None:
    node = root.get("okf_version") if root is not None else None
    if node is None:
        return None
    value = node.value if node.is_scalar else None
    if value is None or not re.fullmatch(r"[0-9]+\.[0-9]+", value):
        doc.say("OKF206", "okf_version is <major>.<minor>", node, "12")
    elif value != VERSION:
        doc.say("OKF207", f"version {value} is not the one that is checked ({VERSION})", node, "12")
    return value


def _sections(doc: Document, body: str) -> None:
    """Headings, each with lists whose entries begin with a link, and nothing else."""
    found = [b for b in markdown.blocks(body) if b.kind != "definition"]
    # blocks by the heading above them; number 0 stands before the first
    number = itertools.accumulate(int(b.kind == "heading") for b in found)
    sections = [[b for _, b in group] for _, group in itertools.groupby(zip(number, found, strict=True), key=lambda x: x[0])]
    ends = [s[0].start for s in sections[1:]] + [len(body)]
    faults = [] if sections else [0]
    for blocks, end in zip(sections, ends, strict=False):
        headed = blocks[0].kind == "heading"
        faults += [b.start for b in blocks[headed:] if not (headed and b.kind == "list")]
        faults += [end] if not any(b.kind == "list" for b in blocks) else []
    entries = [item for b in found for item in b.items or ()]
    defined = markdown.definitions(body) if entries else {}
    for at, first, _ in entries:
        if not markdown.starts_with_link(first, defined):
            doc.say("OKF202", "an entry of an index begins with a link", doc.place(at), "4.1", "error")
    if faults:
        doc.say("OKF201", "an index is made of headings with lists of links", doc.place(min(faults)), "4.1", "error")
