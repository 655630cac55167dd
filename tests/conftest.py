import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from yomibon.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session(
        "local[4]", "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='spark-')}"},
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf_dir():
    folder = os.environ.get("YOMIBON_DATA", "/root/testdata") + "/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    return folder
