import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from srcframe.session import build_session  # noqa: E402
from srcframe.sources.tables import files_from_table  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": 4, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """files table of a ``{path: content}`` map, or of (repo, path, content) rows."""
    def build(content):
        rows = [("r", p, t) for p, t in content.items()] if isinstance(content, dict) else content
        return files_from_table(spark.createDataFrame(rows, "repo string, path string, content string"))

    return build
