"""Large-file pointer texts."""

from pyspark.sql import Column, functions as F

from srcframe.constants import LFS_SPEC_LINE
from srcframe.functions.lines import first_line, strip


def pointer_size(text: Column) -> Column:
    """Real size named by a pointer text, null when the text is no pointer."""
    head = first_line(text)
    # Few texts pass the test on the first line, so their whole text is searched.
    digits = F.regexp_extract(text, r"(?m)^\s*size\s+(\d+)", 1)
    is_pointer = text.contains(LFS_SPEC_LINE) & (strip(head) == LFS_SPEC_LINE)
    return F.when(is_pointer & (digits != ""), digits.cast("bigint"))
