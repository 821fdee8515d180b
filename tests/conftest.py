import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from topicspark.session import get_spark
    folder = tempfile.mkdtemp(prefix="topicspark-tests-")
    s = get_spark("local[4]", 4, app_name="topicspark-tests", extra={"spark.checkpoint.dir": folder})
    yield s
    s.stop()
