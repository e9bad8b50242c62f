import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quantloom.session import local_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_spark(4, **{"spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def bars(spark):
    """Two random walks, one flat series and one short series."""
    import datetime as dt

    import numpy as np
    rng = np.random.default_rng(42)
    rows = []
    for sym, n in ((1, 150), (2, 120), (3, 40), (4, 5)):
        px = np.full(n, 10.0) if sym == 3 else 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in range(n):
            c = float(px[i])
            rows.append((sym, dt.date(2020, 1, 1) + dt.timedelta(days=i), c * 0.99, c * 1.02, c * 0.97, c, float(rng.integers(1, 100))))
    return spark.createDataFrame(rows, "symbol long, date date, open double, high double, low double, close double, volume double")
