"""Line splitting, line classes and text clean-up, all inside the JVM.

Line counts come from counting matches over the whole text. That neither builds an
array of lines nor strips each one, so a long file costs one pass per class.
"""

from functools import reduce

from pyspark.sql import Column, functions as F

from srcframe.constants import (
    BLANKS, HASH_COMMENT_LANGUAGES, LANGUAGE_BY_KEY, LINE_BREAKS,
    SLASH_COMMENT_LANGUAGES, WHITE_SPACE, WHITE_SPACE_CHARS,
)
from srcframe.functions.paths import file_name, suffix

_BREAK = rf"\r\n|[{LINE_BREAKS}]"
# Line breaks other than LF, which most texts do not hold.
_RARE_BREAKS = "\r\v\f\x1c\x1d\x1e\x85\u2028\u2029"


def unify_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF, as text-mode reading does."""
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def _has_rare_break(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(c) for c in _RARE_BREAKS])


def split_lines(text: Column) -> Column:
    """Array of lines; the last line break adds no empty line."""
    def without_tail(parts):
        return F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts)

    parts = F.when(_has_rare_break(text), F.split(text, _BREAK, -1)).otherwise(F.split(text, "\n", -1))
    # Bound by a lambda, so that the text is split once and not at every mention.
    return F.get(F.transform(F.array(parts), without_tail), F.lit(0))


def strip(text: Column) -> Column:
    """Both ends without white space; only the ends are looked at."""
    return F.btrim(text, F.lit(WHITE_SPACE_CHARS))


def _open_tail(text: Column) -> Column:
    """1 when the text ends without a line break, else 0 (also for an empty text)."""
    return F.when(F.right(text, F.lit(1)).rlike(rf"[^{LINE_BREAKS}]"), F.lit(1)).otherwise(F.lit(0))


def _per_break(text: Column, rest: str) -> Column:
    """Matches of a line break followed by ``rest``.

    A search for one literal character is several times faster than one for a class, so
    the class is used only on texts that hold a rare line break.
    """
    # CRLF is one break: its CR does not count.
    any_break = rf"[{LINE_BREAKS}](?<!\r(?=\n))"
    return F.when(_has_rare_break(text), F.regexp_count(text, F.lit(any_break + rest))).otherwise(
        F.regexp_count(text, F.lit("\n" + rest))
    )


def line_count(text: Column) -> Column:
    return (_per_break(text, "") + _open_tail(text)).cast("bigint")


def _line_starts(text: Column) -> Column:
    """The text with a break before its first line, so that every line follows a break."""
    return F.concat(F.lit("\n"), text)


def blank_count(text: Column) -> Column:
    """Lines that hold nothing but white space."""
    hits = _per_break(_line_starts(text), rf"[{BLANKS}]*+(?=[{LINE_BREAKS}]|\z)")
    # The empty stretch after a final line break (or in an empty text) is no line.
    return (hits - (F.lit(1) - _open_tail(text))).cast("bigint")


def _marked(text: Column, marker: str) -> Column:
    return _per_break(_line_starts(text), rf"[{BLANKS}]*+{marker}")


def comment_count(text: Column, language: Column) -> Column:
    """Lines that start with the language's comment marker."""
    return (
        F.when(language.isin(*HASH_COMMENT_LANGUAGES), _marked(text, "#"))
        .when(language.isin(*SLASH_COMMENT_LANGUAGES), _marked(text, "//"))
        .otherwise(F.lit(0))
    ).cast("bigint")


def language_of(path: Column) -> Column:
    """Language by exact file name, then by suffix; null when neither is known."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_KEY.items() for x in pair])
    return F.coalesce(table[file_name(path)], table[suffix(path)])


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def marker_count(text: Column, word: str) -> Column:
    """Whole-word occurrences in any case; letters and digits of any script are word characters."""
    loose = "".join(f"[{c.lower()}{c.upper()}]" for c in word)
    # The dotless i folds to I under Unicode rules.
    loose = loose.replace("[iI]", "[iI\u0131]")
    pattern = rf"(?<![\p{{L}}\p{{N}}_]){loose}(?![\p{{L}}\p{{N}}_])"
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def distill_text(text: Column) -> Column:
    """Comments cut, triple-quoted blocks emptied, blank runs folded, ends stripped."""
    out = F.regexp_replace(text, r"#[^\n]*", "")
    out = F.regexp_replace(out, r'"""[\s\S]*?"""', '"""..."""')
    out = F.regexp_replace(out, r"'''[\s\S]*?'''", "'''...'''")
    out = F.regexp_replace(out, rf"\n[{WHITE_SPACE}]*\n[{WHITE_SPACE}]*", "\n\n")
    return strip(out)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)
