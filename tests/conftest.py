import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from chronoweave import build_session
    wh = tempfile.mkdtemp(prefix="cw-warehouse-")
    s = build_session(master="local[*]", shuffle_partitions=8, extra={"spark.sql.warehouse.dir": wh})
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
