"""One local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

for folder in (os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))):
    sys.path.insert(0, folder)


@pytest.fixture(scope="session")
def spark():
    from repoloom.session import build_session

    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """files rows from {path: text or bytes} of one project."""

    def make(tree: dict, project: str = "p"):
        rows = [(project, path, bytearray(c if isinstance(c, bytes) else c.encode())) for path, c in tree.items()]
        return spark.createDataFrame(rows, "project string, path string, content binary")

    return make
