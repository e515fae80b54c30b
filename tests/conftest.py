import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tablewright.session import local_session

    session = local_session("tests", cores="4", memory="3g", partitions=4)
    session.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    yield session
    session.stop()


@pytest.fixture()
def catalog(spark, tmp_path):
    from tablewright.catalog import Catalog

    return Catalog(spark, str(tmp_path / "store"))
