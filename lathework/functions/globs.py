"""Two glob dialects as regular expressions; compiled on the driver, matched in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def shell_regex(pattern: str) -> str:
    """The shell dialect: ``*`` crosses directories, ``?`` is any character, ``[...]`` a set."""
    out = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 1 if pattern[i : i + 1] in ("!", "]") else i)
            if end < 0:
                out.append(re.escape(c))
            else:
                inner = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
                i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def path_regex(pattern: str) -> str:
    """The path dialect: ``**`` is any depth and takes a slash after it, ``*`` and ``?`` stay in a directory, all else is literal."""
    out = []
    for part in re.findall(r"\*\*/?|\*|\?|[^*?]+", pattern):
        out.append(".*" if part.startswith("**") else "[^/]*" if part == "*" else "[^/]" if part == "?" else re.escape(part))
    return "^" + "".join(out) + "$"


def any_of(column: Column, regexes: Iterable[str]) -> Column:
    """Whether ``column`` matches one of the regular expressions."""
    tests = [column.rlike(r) for r in regexes]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def matches_shell(column: Column, patterns: Iterable[str]) -> Column:
    return any_of(column, map(shell_regex, patterns))


def matches_path(column: Column, patterns: Iterable[str]) -> Column:
    return any_of(column, map(path_regex, patterns))


def matches_owner_rule(column: Column, pattern: str) -> Column:
    """The ownership dialect: a directory, a shell glob on the path or the path after a slash, or a name at a path's start, end or whole."""
    if pattern.endswith("/"):
        return column.startswith(pattern)
    if "*" in pattern:
        return column.rlike(shell_regex(pattern)) | F.concat(F.lit("/"), column).rlike(shell_regex(pattern))
    return (column == pattern) | column.startswith(pattern + "/") | column.endswith("/" + pattern)
