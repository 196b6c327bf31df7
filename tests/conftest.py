from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stocklens.session import local_session  # noqa: E402

DATA = os.environ.get("STOCKLENS_TEST_DATA", "/root/testdata/sf0.001")
STAR = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(8, "stocklens-tests", spark__checkpoint__dir=folder)
    session.sparkContext.setCheckpointDir(folder)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    connection = duckdb.connect()
    for name in STAR:
        connection.sql(f"create view {name} as select * from read_parquet('{data}/{name}.parquet')")
    return connection
