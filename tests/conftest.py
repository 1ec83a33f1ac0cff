import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracegrid.runtime import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_spark("tests", "local[4]", shuffle_partitions="4", **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
