import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from treeledger.session import build_session, ship_library

    session = build_session(
        "tests", "local[4]", spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"), spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__default__parallelism="4"
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_library(session)
    yield session
    session.stop()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
