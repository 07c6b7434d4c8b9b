import os
import tempfile
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallyspark.session import get_spark

    warehouse = tempfile.mkdtemp(prefix="tallyspark-wh-")
    s = get_spark("tallyspark-tests", master="local[*]", shuffle_partitions=8,
                  extra_conf={"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()
