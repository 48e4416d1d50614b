import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from assayer.session import build_session
    s = build_session("local[8]", "tests", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                      spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
                      spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"))
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
