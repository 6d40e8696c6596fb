import os
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(TOP))
os.environ["PYTHONPATH"] = os.pathsep.join([str(TOP), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from evidra.session import session

    s = session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
