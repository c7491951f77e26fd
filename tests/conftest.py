import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lexigrain.session import local

    return local(4, "6g", 4)


@pytest.fixture(scope="session")
def sf():
    return SF
