"""Token counts. The method is a parameter; the default needs no vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# A run of letters, up to three digits, or a run of other visible characters.
WORD_PIECES = r"\p{L}+|\p{N}{1,3}|[^\t-\r \p{L}\p{N}]+"

def joined_token_count(text: Column, method: str, marker: str, blocks_between: int) -> Column:
    """Aggregate: tokens of ``marker``, two line breaks, and the texts of a group joined by
    ``blocks_between`` line breaks, without building the joined text.

    Exact for both named methods; a callable need not add up and is refused.
    """
    if method == "pieces":
        return F.sum(token_count(text, method)) + F.first(token_count(F.lit(marker), method))
    if method == "chars4":
        whole = F.sum(F.length(text)) + (F.count("*") - 1) * blocks_between + len(marker) + 2
        return F.ceil(whole / F.lit(4)).cast("bigint")
    raise ValueError("only named methods add up over joined texts")


def token_count(text: Column, method: str | Callable[[Column], Column] = "pieces") -> Column:
    """Tokens in ``text``.

    ``pieces`` counts word pieces, ``chars4`` takes a quarter of the characters, and a
    callable gets the column: pass a Pandas UDF that wraps a local vocabulary.
    """
    if callable(method):
        return method(text).cast("bigint")
    if method == "pieces":
        return F.regexp_count(text, F.lit(WORD_PIECES)).cast("bigint")
    if method == "chars4":
        return F.ceil(F.length(text) / F.lit(4)).cast("bigint")
    raise ValueError(f"unknown token method: {method}")
