import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from callsheet.schemas import SCHEMAS  # noqa: E402
from callsheet.session import session_builder  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        session_builder("tests")
        .master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Make an input table from dicts; columns left out are NULL."""

    def build(table, *rows):
        names = SCHEMAS[table].fieldNames()
        unknown = {key for row in rows for key in row} - set(names)
        assert not unknown, unknown
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMAS[table])

    return build
