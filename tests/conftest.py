import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from check_oracles import session

    return session(4)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    """Builds a DataFrame from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
