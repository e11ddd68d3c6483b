"""Secrets in texts: one row per line and rule, with every secret value masked."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from srcframe.functions.lines import split_lines, strip
from srcframe.session import compute_once

MASK = "****"


class SecretRule(NamedTuple):
    """``regex`` has two groups: what stays readable, and the value to mask.

    Every match holds one of ``hints``; texts without any are never searched.
    """

    secret_type: str
    regex: str
    hints: tuple[str, ...]


# Formats their issuers publish; the syntax is shared by the common regex engines.
DEFAULT_RULES = (
    SecretRule("aws_access_key_id", r"(\b)((?:AKIA|ASIA)[0-9A-Z]{16})\b", ("AKIA", "ASIA")),
    SecretRule("github_token", r"(\b)(gh[pousr]_[0-9A-Za-z]{36})\b",
               ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    SecretRule("slack_token", r"(\b)(xox[abprs]-[0-9A-Za-z-]{10,})", ("xox",)),
    SecretRule("google_api_key", r"(\b)(AIza[0-9A-Za-z_-]{35})", ("AIza",)),
    SecretRule("private_key", r"(-----BEGIN )((?:[A-Z]+ )?PRIVATE KEY-----)", ("PRIVATE KEY-----",)),
    SecretRule("jwt", r"(\b)(eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})", ("eyJ",)),
    SecretRule(
        "assigned_secret",
        r"((?:[Kk]ey|KEY|[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD)[ \t]*[:=][ \t]*[\"'])"
        r"([^\"'\n]{8,})",
        ("key", "Key", "KEY", "oken", "TOKEN", "ecret", "SECRET", "assword", "PASSWORD"),
    ),
)


def _holds(text: Column, rule: SecretRule) -> Column:
    hinted = reduce(lambda a, b: a | b, [text.contains(h) for h in rule.hints])
    return hinted & text.rlike(rule.regex)


def _any(text: Column, rules: Sequence[SecretRule]) -> Column:
    return reduce(lambda a, b: a | b, [_holds(text, r) for r in rules])


def masked(line: Column, rules: Sequence[SecretRule]) -> Column:
    """The line with the values of all rules masked, so that no row leaks another's."""
    return reduce(lambda text, r: F.regexp_replace(text, r.regex, f"$1{MASK}"), rules, line)


def secret_hits(text: Column, rules: Sequence[SecretRule] = DEFAULT_RULES) -> Column:
    """Array of (secret_type, line_number, line_content), one entry per line and rule.

    A text without any match is never split, and only matching lines are looked at
    rule by rule.
    """
    numbered = F.transform(
        split_lines(text), lambda line, i: F.struct((i + 1).alias("n"), line.alias("line"))
    )

    def entries(hit):
        line = hit["line"]
        types = F.array(*[F.when(_holds(line, r), F.lit(r.secret_type)) for r in rules])
        content = strip(masked(line, rules))
        return F.transform(F.array_compact(types), lambda kind: F.struct(
            kind.alias("secret_type"), hit["n"].alias("line_number"), content.alias("line_content")
        ))

    hits = F.filter(numbered, lambda s: _any(s["line"], rules))
    return F.when(_any(text, rules), F.flatten(F.transform(hits, entries)))


def listed_secrets(hits: DataFrame) -> DataFrame:
    """Rows (repo, file_path, secret_type, line_number, line_content) of a ``secrets`` array."""
    return hits.select("repo", F.col("path").alias("file_path"), F.inline("secrets"))


def find_secrets(files: DataFrame, rules: Sequence[SecretRule] = DEFAULT_RULES) -> DataFrame:
    """One row per line and rule that match, with the secret values masked."""
    return listed_secrets(compute_once(files, secrets=secret_hits(F.col("content"), rules)))
