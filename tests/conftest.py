import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from seriesloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Three monthly series of 60 rows with trend, season and fixed noise: (member, ts, total)."""
    import datetime as dt
    import random

    rnd = random.Random(7)
    rows = []
    for k, member in enumerate(("A", "B", "C")):
        for i in range(60):
            ts = dt.date(2000 + i // 12, i % 12 + 1, 1)
            rows.append((member, ts, 100.0 + 20 * k + 0.8 * i + 6 * ((i % 12) - 5) * (k + 1) / 3 + rnd.uniform(-4, 4)))
    return spark.createDataFrame(rows, "member string, ts date, total double"), rows
