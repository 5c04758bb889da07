"""Ignore patterns: ordered, the last that fits decides, ``!`` negates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_regex(pattern: str, compatible: bool = False) -> str:
    """A Java regex for whole paths. Proper: ``**`` crosses folders, ``*`` and ``?`` don't, a slash anchors at the root.

    ``compatible``: shell matching as simple tools do it: without ``**`` a ``*`` crosses folders; with it, it does not.
    """
    if compatible and "**" not in pattern:
        translate = {"*": ".*", "?": "."}
        return "(?s)" + "".join(_classes(pattern, translate))
    if compatible:
        return re.sub(r"\\\*(?:\\\*)?", "[^/]*", re.escape(pattern)).replace("[^/]*[^/]*", "[^/]*")
    body = pattern.rstrip("/")
    anchored = "/" in body
    out, i = "", 0
    body = body.lstrip("/")
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out + "(?:/.*)?"


def _classes(pattern: str, translate: dict[str, str]):
    i = 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\")
            yield "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = close + 1
        else:
            yield translate.get(c) or re.escape(c)
            i += 1


def patterns_of(lines: list[str]) -> list[str]:
    """Without blanks at the ends, empty lines and comments."""
    return [x for x in (line.strip() for line in lines) if x and not x.startswith("#")]


def ignored(path: Column, patterns: list[str], compatible: bool = False) -> Column:
    """Whether the last pattern that fits says so. The list is a file of the user's, so it becomes one expression."""
    out = F.lit(False)
    base = F.element_at(F.split(path, "/"), -1)
    for p in patterns:
        no = p.startswith("!")
        regex = "^(?:" + to_regex(p[no:], compatible) + r")\z"
        fits = path.rlike(regex) | base.rlike(regex) if compatible else path.rlike(regex)
        out = F.when(fits, F.lit(not no)).otherwise(out)
    return out


def with_ignored(pages: DataFrame, patterns: list[str], path_col: str = "path", out: str = "local_ignored") -> DataFrame:
    return pages.withColumn(out, ignored(F.col(path_col), patterns))


def in_scope(path: Column, prefixes: list[str]) -> Column:
    """Whether the path begins with one of the prefixes, as text; without any, all do."""
    return F.lit(True) if not prefixes else F.exists(F.array(*[F.lit(x) for x in prefixes]), lambda x: F.startswith(path, x))
