"""Schemas of the tables that leave Python workers or are stored."""

from pyspark.sql import types as T


def _fields(*pairs):
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


RAW_FILES = _fields(
    ("repo", T.StringType()),
    ("path", T.StringType()),
    ("disk_size", T.LongType()),
    ("is_symlink", T.BooleanType()),
    ("is_dir", T.BooleanType()),
    ("location", T.StringType()),
)

FUNCTION = _fields(
    ("ord", T.IntegerType()),
    ("function_name", T.StringType()),
    ("line_number", T.IntegerType()),
    ("complexity_score", T.IntegerType()),
)

PYTHON_METRICS = _fields(
    ("functions", T.ArrayType(FUNCTION)),
    ("halstead_volume", T.DoubleType()),
    ("halstead_effort", T.DoubleType()),
)

IGNORE_RULE = _fields(("regex", T.StringType()), ("negated", T.BooleanType()))

DEPENDENCY_SCAN = T.StructType([
    T.StructField("results", T.ArrayType(_fields(
        ("packages", T.ArrayType(_fields(
            ("package", _fields(("name", T.StringType()), ("version", T.StringType()))),
            ("vulnerabilities", T.ArrayType(_fields(
                ("id", T.StringType()),
                ("summary", T.StringType()),
                ("database_specific", _fields(("severity", T.StringType()))),
            ))),
        ))),
    )))
])

CODE_SCAN = T.StructType([
    T.StructField("results", T.ArrayType(_fields(
        ("check_id", T.StringType()),
        ("path", T.StringType()),
        ("start", _fields(("line", T.LongType()))),
        ("extra", _fields(("message", T.StringType()), ("severity", T.StringType()))),
    )))
])
