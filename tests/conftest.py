from __future__ import annotations

import os
import sys

import pytest

_TESTS = os.path.dirname(os.path.abspath(__file__))
_ROOT = os.path.dirname(_TESTS)
sys.path.insert(0, _ROOT)
# Python workers (mapInPandas) must import the package and the test modules whose
# functions they run; they inherit this from the JVM started below.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [_ROOT, _TESTS] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p])

from purchaseflow.session import build_session, checkpoint_dir  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=4, app_name="purchaseflow-tests")
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
