import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lakeshore.session import build_session
    session = build_session("local[4]", app_name="lakeshore-tests", shuffle_partitions=4,
                            conf={"spark.ui.showConsoleProgress": "false",
                                  "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="lakeshore-wh-")})
    yield session
    session.stop()


@pytest.fixture()
def workdir():
    return tempfile.mkdtemp(prefix="lakeshore-test-")
