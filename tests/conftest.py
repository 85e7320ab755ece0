import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pagetide.operators import skew  # noqa: E402
from pagetide.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        8, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "split"])
def hot_mode(request, monkeypatch):
    """Run a test with and without splitting of hot keys; 'split' calls every key with over 10 rows hot."""
    if request.param == "split":
        monkeypatch.setattr(skew, "SMALLEST", 10)
        monkeypatch.setattr(skew, "SALTS", 5)
    return request.param
