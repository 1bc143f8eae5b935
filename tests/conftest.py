import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from docloom.session import local_session

    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = local_session(cores=4, shuffle_partitions=4, app="docloom-tests",
                            conf={"spark.sql.warehouse.dir": warehouse})
    yield session
    session.stop()
