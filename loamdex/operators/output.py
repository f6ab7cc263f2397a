"""Pages as text for people, as paths, or as JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from loamdex.errors import InvalidArgument

FORMATS = ("pretty", "paths", "json")


@dataclass
class Page:
    items: list[dict[str, Any]]
    next_cursor: str | None = None
    has_more: bool = False
    explain_plan: str | None = None
    explain_steps: list[str] | None = field(default=None)


def _shown(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def render(page: Page, style: str = "pretty", elapsed_ms: int | None = None) -> str:
    name = style.lower() or "pretty"
    if name not in FORMATS:
        raise InvalidArgument(f"unknown format {style!r}; expected {', '.join(FORMATS)}")
    if name == "paths":
        return "".join(f"{i['path']}\n" for i in page.items if isinstance(i.get("path"), str))
    if name == "json":
        body = {"items": page.items, "next_cursor": page.next_cursor, "has_more": page.has_more, "explain_sql": page.explain_plan, "explain_steps": page.explain_steps}
        return json.dumps({k: v for k, v in body.items() if v is not None}, indent=2, ensure_ascii=False) + "\n"
    n = len(page.items)
    lines = [f"Found {n} item{'' if n == 1 else 's'}" + ("" if elapsed_ms is None else f" in {elapsed_ms}ms")]
    for item in page.items:
        lines.append(f"- {item.get('path', '(no path)')}")
        lines += [f"  {k}: {_shown(item[k])}" for k in sorted(item) if k != "path"]
    if page.next_cursor:
        lines += ["", f"Next cursor: {page.next_cursor}"]
    elif page.has_more:
        lines += ["", "More results available"]
    if page.explain_steps:
        lines += ["", "Explanation:", *[f"  {s}" for s in page.explain_steps]]
    if page.explain_plan:
        lines += ["", f"SQL: {page.explain_plan}"]
    return "\n".join(lines) + "\n"
