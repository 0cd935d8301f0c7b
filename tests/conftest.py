import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from lodestar.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session("tests", "local[*]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    found.sparkContext.setLogLevel("ERROR")
    yield found


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
