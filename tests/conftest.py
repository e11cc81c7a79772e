import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from calendar_helpers import month  # noqa: E402

from tideloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, app="tests", memory="4g")


@pytest.fixture(scope="session")
def panel_of(spark):
    def make(series: dict[str, list], start: int = 0, value: str = "y"):
        rows = [(k, month(start + i), None if v is None else float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, f"id string, ds date, {value} double")

    return make
