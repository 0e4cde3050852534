import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tests.scales import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from riskfeatures.session import get_session
    s = get_session("local[4]", 4, app_name="riskfeatures-tests")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from riskfeatures.sources.roles import BASE_TABLES
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
