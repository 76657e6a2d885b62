import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerloom.session import clear_staged, local_session, staged_path  # noqa: E402
from ledgerloom.sources import TX_SCHEMA  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, app="tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_staged(session)
    assert not Path(staged_path(session, "none")).parent.exists(), "staged tables are left behind"


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture
def tx(spark):
    """Build a log from (invoice, stock, quantity, 'YYYY-MM-DD HH:MM', price, customer) rows."""

    def build(rows):
        from ledgerloom.operators.cleaning import flag_returns

        typed = [
            (i, s, float(q), datetime.fromisoformat(t), float(p), c) for i, s, q, t, p, c in rows
        ]
        return flag_returns(spark.createDataFrame(typed, TX_SCHEMA))

    return build
