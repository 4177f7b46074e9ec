import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from upkeep.session import build_session, ensure_test_checkpoint_dir
    s = build_session(master="local[4]", app="upkeep-tests", shuffle_partitions=8)
    ensure_test_checkpoint_dir(s, tempfile.mkdtemp(prefix="upkeep-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from tools.check_oracle import duck
    return duck(SF_SMALL)


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="upkeep-test-")
