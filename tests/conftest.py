import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rasterloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", master="local[8]", shuffle_partitions=4,
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "6g",
                             "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def pixels(spark):
    """Build a pixel table from (row, col, p) tuples or a 2-D array."""
    import numpy as np

    def build(data, names="row int, col int, p double"):
        if isinstance(data, np.ndarray):
            data = [(int(r), int(c), float(data[r, c])) for r in range(data.shape[0]) for c in range(data.shape[1])]
        return spark.createDataFrame(data, names)
    return build
