import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SAMPLE_DOC = os.path.join(ROOT, "tests", "data", "sample_document.txt")


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session
    s = build_session("local[4]", app="tessera-tests", shuffle_partitions=8)
    yield s
    s.stop()
