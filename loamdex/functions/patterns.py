"""LIKE and GLOB as the data model knows them: LIKE folds A-Z and has no escape, GLOB is exact and knows classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


def folded(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def like(column: Column, pattern: str) -> Column:
    """LIKE with ASCII folding; a backslash in the pattern is a plain character."""
    return folded(column).like(pattern.translate(_FOLD).replace("\\", "\\\\"))


def glob_regex(pattern: str) -> str:
    """An anchored Java regex: * and ? cross anything, [..] and [^..] are classes with ranges; an open [ matches nothing."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            negated = pattern[i : i + 1] == "^"
            start = i + negated
            # a ] right after the opening stands for itself
            end = pattern.find("]", start + 1)
            if end < 0:
                return r"\A(?!)\z"
            body, k, parts = pattern[start:end], 0, []
            while k < len(body):
                if k + 2 < len(body) and body[k + 1] == "-":
                    low, high = body[k], body[k + 2]
                    if low <= high:
                        parts.append(f"{_plain(low)}-{_plain(high)}")
                    k += 3
                else:
                    parts.append(_plain(body[k]))
                    k += 1
            out.append(f"[{'^' if negated else ''}{''.join(parts)}]" if parts else ("." if negated else "(?!)"))
            i = end + 1
        else:
            out.append(_plain(c))
    return r"(?s)\A" + "".join(out) + r"\z"


def _plain(c: str) -> str:
    return c if c.isalnum() else f"\\x{{{ord(c):x}}}"


def glob(column: Column, pattern: str) -> Column:
    prefix = re.split(r"[*?\[]", pattern, maxsplit=1)[0]
    if prefix == pattern:
        return column == F.lit(pattern)
    test = column.rlike(glob_regex(pattern))
    return F.startswith(column, F.lit(prefix)) & test if prefix else test
