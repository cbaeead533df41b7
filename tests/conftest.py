import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from clientele.session import build_session, ensure_checkpoint_dir
    s = build_session("local[4]", shuffle_partitions=4, driver_memory="8g",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="clientele-test-")})
    ensure_checkpoint_dir(s)
    yield s
    s.stop()
