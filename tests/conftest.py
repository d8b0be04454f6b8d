import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from leafmill.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session("tests", spark_master="local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="4g")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
