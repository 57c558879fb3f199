import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kairos.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="kairos-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="kairos-test-ckpt-"),
                             "spark.driver.memory": "4g"})
    yield s
    s.stop()
