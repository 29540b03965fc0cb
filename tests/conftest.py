import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from evalkit.session import build_session
    # tests set their own shared folder only because none is configured
    os.environ.setdefault("EVALKIT_DRIVER_MEMORY", "4g")
    s = build_session("local[4]", app="evalkit-tests", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="evalkit-test-ckpt-")})
    yield s
    from evalkit.session import remove_scratch
    remove_scratch(s)
    s.stop()
