from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import build_session

    return build_session("tests", 8)


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SMALL
