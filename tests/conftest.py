import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from probity.session import get_session
    os.environ.setdefault("PROBITY_SCRATCH", tempfile.mkdtemp(prefix="probity-tests-"))
    s = get_session("local[4]", app="probity-tests", shuffle_partitions=4,
                    extra={"spark.sql.adaptive.coalescePartitions.enabled": "false"})
    yield s
    s.stop()


SF_SMOKE = "/root/testdata/sf0.001"
