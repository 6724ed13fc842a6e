import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from textloom.session import session

    shared = tmp_path_factory.mktemp("shared").as_uri()
    options = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.log.level": "ERROR", "spark.checkpoint.dir": shared}
    s = session("tests", "local[4]", **options)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
