import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from herdflow.session import build_session

    s = build_session("local[2]", app="herdflow-tests", shuffle_partitions=4)
    # the shared checkpoint folder comes from the session; herdflow.session
    # falls back to a private folder only when it is unset
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
