"""Ignore patterns with the semantics of .gitignore, as one Column: the last pattern that matches decides."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is ignored without patterns of one's own.
DEFAULTS = ("node_modules/", ".git/", "dist/", "build/", ".env*", "*.pem", "*.key", "*.p12")


def to_regex(pattern: str) -> tuple[str, bool] | None:
    """The regex of a pattern over slash-separated relative paths, and whether it takes back what others ignore."""
    line = pattern.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    only_dir = line.endswith("/")
    body = line.strip("/")
    anchored = "/" in line.rstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i:]:
            end = body.index("]", i)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return f"{'^' if anchored else '(?:^|/)'}{out}{'/' if only_dir else '(?:/|$)'}", negated


def ignored(path: Column, patterns: tuple[str, ...] | None = None) -> Column:
    """Whether the path of a file is ignored; without patterns the defaults hold."""
    out = F.lit(False)
    for p in DEFAULTS if patterns is None else patterns:
        if (r := to_regex(p)) is not None:
            out = F.when(path.rlike(r[0]), F.lit(not r[1])).otherwise(out)
    return out
