"""Globs as regular expressions, for the Java engine.

Two dialects: shell globs (``*`` crosses slashes, whole-name match) and ignore-file
patterns (``*`` stays within one path part, ``**`` crosses).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from srcframe.schemas import IGNORE_RULE

_SPECIAL = set("\\^$.|?*+()[]{}-&~#/ ")


def _literal(char: str) -> str:
    return "\\" + char if char in _SPECIAL else char


def quote(text: str) -> str:
    """A regex that matches exactly this text."""
    return "".join(_literal(c) for c in text)


def _char_class(glob: str, start: int, negators: str) -> tuple[str, int] | None:
    """Translate the ``[...]`` that opens at ``start``; None when it never closes."""
    negated = glob[start + 1:start + 2] != "" and glob[start + 1] in negators
    first = start + 2 if negated else start + 1
    close = glob.find("]", first + 1)  # a bracket right after the opening is a member
    if close < 0:
        return None
    members, body = glob[first:close], ""
    at = 0
    while at < len(members):
        if at + 2 < len(members) and members[at + 1] == "-":
            low, high = members[at], members[at + 2]
            if low <= high:  # a backward range has no members
                body += f"{_literal(low)}-{_literal(high)}"
            at += 3
        else:
            body += _literal(members[at])
            at += 1
    if not body:
        return ("(?s:.)" if negated else "(?!)"), close + 1
    return f"[{'^' if negated else ''}{body}]", close + 1


def shell_regex(glob: str) -> str:
    """Regular expression that matches exactly the whole names the shell glob does."""
    out, at = "", 0
    while at < len(glob):
        char = glob[at]
        if char == "[" and (found := _char_class(glob, at, "!")):
            out += found[0]
            at = found[1]
            continue
        out += {"*": ".*", "?": "."}.get(char) or _literal(char)
        at += 1
    return rf"(?s)\A(?:{out})\z"


def ignore_regex(line: str) -> tuple[str, bool] | None:
    """(regex, negated) of one ignore-file line, None for blanks and comments.

    The regex is matched against a path where directories end in a slash.
    """
    rule = line.rstrip("\r\n")
    while rule.endswith(" ") and not rule.endswith("\\ "):
        rule = rule[:-1]
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[1:] if negated else rule
    only_dirs = rule.endswith("/")
    rule = rule.rstrip("/") if only_dirs else rule
    anchored = "/" in rule
    rule = rule.removeprefix("/")
    if not rule:
        return None
    out, at = "", 0
    while at < len(rule):
        rest = rule[at:]
        if rest.startswith("**/") and (at == 0 or rule[at - 1] == "/"):
            out, at = out + "(?:.*/)?", at + 3
        elif rest == "**" and at > 0 and rule[at - 1] == "/":
            out, at = out + ".+", at + 2
        elif rest[0] == "*":
            at += len(rest) - len(rest.lstrip("*"))
            out += "[^/]*"
        elif rest[0] == "?":
            out, at = out + "[^/]", at + 1
        elif rest[0] == "[" and (found := _char_class(rule, at, "!^")):
            out += "(?!/)" + found[0]
            at = found[1]
        elif rest[0] == "\\" and len(rest) > 1:
            out, at = out + _literal(rest[1]), at + 2
        else:
            out, at = out + _literal(rest[0]), at + 1
    head = "" if anchored else "(?:.*/)?"
    return f"{head}{out}{'/' if only_dirs else '/?'}", negated


def any_shell_match(name: Column, globs: list[str]) -> Column:
    """True when ``name`` matches one of the driver-side globs (one literal regex)."""
    if not globs:
        return F.lit(False)
    return name.rlike("|".join(f"(?:{shell_regex(g)})" for g in globs))


@pandas_udf(StringType())
def shell_regex_col(globs):
    return globs.map(lambda g: None if g is None else shell_regex(g))


@pandas_udf(IGNORE_RULE)
def ignore_regex_col(lines):
    import pandas as pd

    parsed = [(ignore_regex(x) if x is not None else None) or (None, None) for x in lines]
    return pd.DataFrame(parsed, columns=["regex", "negated"])
