import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from planframe.session import local  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local("4", 4, "4g")
