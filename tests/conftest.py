import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestone.session import get_spark

    s = get_spark("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("wh")))
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cp")))
    yield s
    s.stop()
