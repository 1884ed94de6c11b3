import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pinax.session import build_session, checkpoint_dir

    s = build_session("local[*]", shuffle_partitions=8)
    # Tests only: a local checkpoint folder when the environment names none.
    checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="pinax-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="pinax-test-", dir="/tmp")
