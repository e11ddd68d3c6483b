"""Bytes to text: invalid UTF-8 is dropped, line ends are unified."""

from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from srcframe.functions.lines import unify_newlines


@pandas_udf(StringType())
def _drop_bad_bytes(raw):
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def decode_text(raw: Column) -> Column:
    """Only rows with bad bytes pay the trip to a Python worker.

    The worker gets null for good rows, so Arrow carries no text for them.
    """
    good = F.is_valid_utf8(raw.cast("string"))
    repaired = _drop_bad_bytes(F.when(~good, raw))
    return unify_newlines(F.coalesce(repaired, F.when(good, raw.cast("string"))))
