"""The part of CommonMark that bundles need: headings, lists, code blocks, links and footnote definitions, with places."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})(.*)$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)(.*)$")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>]*>|\S+)")
_FOOTNOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+)>")
_INLINE = re.compile(r"""\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""")


@dataclass
class Block:
    """kind: heading, list, code, rule, paragraph, html, quote. start: offset in the text."""

    kind: str
    start: int
    end: int
    level: int = 0
    text: str = ""
    items: list[tuple[int, str, int]] | None = None
    section: str = ""


def _lines(text: str) -> list[tuple[int, str, int]]:
    """(offset, content, end) of each line."""
    out, at = [], 0
    for line in text.splitlines(keepends=True) if "\x0b" not in text and "\x0c" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        out.append((at, line.rstrip("\r\n"), at + len(line)))
        at += len(line)
    return out


def blocks(text: str) -> list[Block]:
    """Top-level blocks in order."""
    lines, out, i = _lines(text), [], 0
    while i < len(lines):
        start, line, end = lines[i]
        if not line.strip():
            i += 1
            continue
        if m := _FENCE.match(line):
            i += 1
            fence = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            while i < len(lines) and not fence.match(lines[i][1]):
                i += 1
            end = lines[min(i, len(lines) - 1)][2]
            i += 1
            out.append(Block("code", start + len(m[1]), end))
        elif line.startswith(("    ", "\t")):
            while i < len(lines) and (lines[i][1].startswith(("    ", "\t")) or not lines[i][1].strip()):
                end = lines[i][2]
                i += 1
            out.append(Block("code", start + (4 if line.startswith("    ") else 1), end))
        elif m := _ATX.match(line):
            out.append(Block("heading", start + len(line) - len(line.lstrip(" ")), end, len(m[1]), m[2] or ""))
            i += 1
        elif _RULE.match(line):
            out.append(Block("rule", start, end))
            i += 1
        elif _ITEM.match(line):
            i, block = _list(lines, i)
            out.append(block)
        elif line.lstrip(" ").startswith(">"):
            while i < len(lines) and lines[i][1].strip():
                end = lines[i][2]
                i += 1
            out.append(Block("quote", start, end, text=text[start:end]))
        elif re.match(r" {0,3}<(?:[A-Za-z/!?])", line) and not _AUTOLINK.match(line.lstrip()):
            while i < len(lines) and lines[i][1].strip():
                end = lines[i][2]
                i += 1
            out.append(Block("html", start, end))
        elif _DEFINITION.match(line) and not _FOOTNOTE.match(line):
            out.append(Block("definition", start, end))
            i += 1
        else:
            i, block = _paragraph(lines, i, text)
            out.append(block)
    section = ""
    for block in out:
        if block.kind == "heading" and block.level == 1:
            section = plain(block.text).strip()
        block.section = section
    return out


def _paragraph(lines: list[tuple[int, str, int]], i: int, text: str) -> tuple[int, Block]:
    start = lines[i][0] + len(lines[i][1]) - len(lines[i][1].lstrip(" "))
    first = i
    while i < len(lines):
        _, line, end = lines[i]
        if i > first and (m := _SETEXT.match(line)):
            return i + 1, Block("heading", start, end, 1 if m[1][0] == "=" else 2, text[start : lines[i - 1][2]].strip())
        if not line.strip() or (i > first and (_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or line.lstrip(" ").startswith(">") or ((m := _ITEM.match(line)) and m[4].strip() and not re.match(r"(?!1[.)])\d", m[2])))):
            break
        i += 1
    return i, Block("paragraph", start, lines[i - 1][2], text=text[start : lines[i - 1][2]])


def _list(lines: list[tuple[int, str, int]], i: int) -> tuple[int, Block]:
    """A list with its outermost items as (offset, first line, end)."""
    start = lines[i][0] + len(lines[i][1]) - len(lines[i][1].lstrip(" "))
    items: list[list] = []
    indent = 0
    mark = ""
    while i < len(lines):
        at, line, end = lines[i]
        blank = not line.strip()
        depth = len(line) - len(line.lstrip(" "))
        m = _ITEM.match(line)
        kind = m[2][-1] if m else ""
        if m and not _RULE.match(line) and (not items or (depth < indent and kind == mark)):
            items.append([at + len(m[1]), m[4], end])
            indent, mark = len(m[1]) + len(m[2]) + min(max(len(m[3]), 1), 4 if len(m[3]) <= 4 else 1), kind
        elif blank:
            ahead = next((lines[k] for k in range(i, len(lines)) if lines[k][1].strip()), None)
            if ahead is None:
                break
            following = len(ahead[1]) - len(ahead[1].lstrip(" "))
            nxt = _ITEM.match(ahead[1])
            if following < indent and not (nxt and nxt[2][-1] == mark and not _RULE.match(ahead[1])):
                break
        elif depth >= indent:
            items[-1][2] = end
        elif m or _ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or line.lstrip(" ").startswith(">"):
            break
        else:
            items[-1][2] = end
        i += 1
    return i, Block("list", start, lines[i - 1][2] if i else 0, items=[tuple(x) for x in items])


def plain(text: str) -> str:
    """Inline text without its markers: what code spans, links and emphasis show."""
    text = re.sub(r"(`+)(.+?)\1(?!`)", lambda m: m[2].strip(), text)
    text = re.sub(r"!?\[([^\[\]]*)\](?:\([^()]*\)|\[[^\[\]]*\])?", r"\1", text)
    text = re.sub(r"(\*\*|__|\*|_)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text)


def _label(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip()).casefold()


def _unescaped(url: str) -> str:
    url = url[1:-1] if url.startswith("<") and url.endswith(">") else url
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", url)


def starts_with_link(text: str, defined: dict[str, str]) -> bool:
    """Whether inline text begins with a link; defined: the definitions of its document."""
    text = text.lstrip()
    return bool(_AUTOLINK.match(text)) or any(at == 0 for at, _ in _links_in(text, defined))


def definitions(text: str, found: list[Block] | None = None) -> dict[str, str]:
    """Destinations of reference links by label."""
    out: dict[str, str] = {}
    for block in blocks(text) if found is None else found:
        if block.kind == "definition" and (m := _DEFINITION.match(text[block.start : block.end])):
            out.setdefault(_label(m[1]), _unescaped(m[2]))
    return out


def links(text: str) -> list[tuple[int, str]]:
    """(offset, destination) of inline, reference and automatic links outside code and raw HTML, in order."""
    found, hidden = blocks(text), []
    for b in found:
        if b.kind in ("code", "html", "definition"):
            hidden.append((b.start, b.end))
        elif b.kind in ("list", "quote"):
            # fences within containers
            for m in re.finditer(r"^[ \t>]*(`{3,}|~{3,})[^\n]*\n(?:.*\n)*?[ \t>]*\1[^\n]*$", text[b.start : b.end], re.M):
                hidden.append((b.start + m.start(), b.start + m.end()))
    parts, at = [], 0
    for a, b in sorted(hidden):
        parts += [text[at:a], re.sub(r"[^\n]", "\0", text[max(a, at) : b])]
        at = max(at, b)
    return _links_in("".join([*parts, text[at:]]), definitions(text, found))


_BACKTICKS = re.compile(r"`+")
_RAW_HTML = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_REFERENCE = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")
_SPECIAL = re.compile(r"[\\`<\[\]]")


def _links_in(text: str, defined: dict[str, str]) -> list[tuple[int, str]]:
    # of every length of a run of backticks, where such runs start: a span ends at the next of its own length
    runs: dict[int, list[int]] = {}
    for m in _BACKTICKS.finditer(text):
        runs.setdefault(m.end() - m.start(), []).append(m.start())
    comment_end = text.rfind("-->")
    out, i, opened = [], 0, []
    while m := _SPECIAL.search(text, i):
        i = m.start()
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            run = _BACKTICKS.match(text, i).end() - i
            same = runs.get(run, [])
            k = bisect.bisect_left(same, i + run)
            i = same[k] + run if k < len(same) else i + run
        elif c == "<" and (m := _AUTOLINK.match(text, i)):
            out.append((i, m[1] if ":" in m[1] else f"mailto:{m[1]}"))
            i = m.end()
        elif c == "<" and not (text.startswith("<!--", i) and comment_end < i) and (m := _RAW_HTML.match(text, i)):
            i = m.end()
        elif c == "[":
            opened.append((i, i > 0 and text[i - 1] == "!"))
            i += 1
        elif c == "]" and opened:
            at, image = opened.pop()
            label = text[at + 1 : i]
            target, end = None, i + 1
            if m := _INLINE.match(text, i + 1):
                target, end = _unescaped(m[1]), m.end()
            elif (m := _REFERENCE.match(text, i + 1)) and _label(m[1] or label) in defined:
                target, end = defined[_label(m[1] or label)], m.end()
            elif not label.startswith("^") and _label(label) in defined:
                target = defined[_label(label)]
            if target is not None:
                if not image:
                    out.append((at, target))
                    # links don't nest
                    opened = [(a, True) if not im else (a, im) for a, im in opened]
                i = end
            else:
                i += 1
        else:
            i += 1
    return sorted(out)


def footnotes(text: str, found: list[Block] | None = None) -> list[tuple[int, str]]:
    """(offset, label) of footnote definitions outside code."""
    code = [(b.start, b.end) for b in (blocks(text) if found is None else found) if b.kind == "code"]
    out = []
    for at, line, _ in _lines(text):
        k = bisect.bisect_right(code, (at, len(text))) - 1
        if (m := _FOOTNOTE.match(line)) and not (k >= 0 and at < code[k][1]):
            out.append((at + len(line) - len(line.lstrip(" ")), m[1]))
    return out
