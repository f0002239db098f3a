from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallyweave.session import build_session

    session = build_session("tests", "*", 8)
    if not session.sparkContext.getConf().get("spark.checkpoint.dir"):
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-"))
    return session


@pytest.fixture(scope="session")
def duck_small():
    from compare import duck

    return duck(SMALL)
