import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpuspulse.session import get_spark
    s = get_spark("corpuspulse-tests", master="local[*]", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    from corpuspulse.session import checkpoint_dir
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tmp_root():
    return tempfile.mkdtemp(prefix="corpuspulse-test-")
