import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyscope.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "4", "tests", **{
            "spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        })
    yield session
    session.stop()


def quarters(start, n):
    return [start + dt.timedelta(days=90 * i) for i in range(n)]


CORPORATE = "entity_id string, period_date date, revenue double, cogs double, operating_expenses double, net_profit double, total_assets double, total_liabilities double, equity double, debt double, cash double"


@pytest.fixture(scope="session")
def companies(spark):
    """The corporate and the competitor statement, four quarters each."""
    a = [(100, 55, 25, 15, 400, 180, 220, 90, 60), (110, 58, 26, 18, 420, 190, 230, 92, 65), (120, 62, 27, 21, 435, 195, 240, 90, 68), (130, 66, 28, 25, 450, 195, 255, 88, 72)]
    b = [(140, 70, 32, 28, 500, 200, 300, 110, 85), (150, 74, 33, 32, 520, 205, 315, 108, 92), (162, 78, 34, 37, 540, 210, 330, 105, 98), (175, 82, 35, 42, 560, 215, 345, 102, 105)]
    days = quarters(dt.date(2024, 1, 1), 4)
    rows = [("corp", d, *map(float, r)) for d, r in zip(days, a)] + [("rival", d, *map(float, r)) for d, r in zip(days, b)]
    return spark.createDataFrame(rows, CORPORATE)


@pytest.fixture(scope="session")
def bank(spark):
    rows = []
    for i, d in enumerate(quarters(dt.date(2023, 1, 1), 4)):
        rows.append(("bank", d, *map(float, (10000 + 500 * i, 8000 + 400 * i, 4500 + 200 * i, 180 + 5 * i, 40 + 2 * i, 80 + 3 * i, 200 - 5 * i, 50 + i, 60 + 2 * i, 12000 + 250 * i, 1500 + 40 * i))))
    return spark.createDataFrame(rows, "entity_id string, period_date date, deposits double, loans double, casa double, net_interest_income double, non_interest_income double, "
                                       "operating_expenses double, gross_npa double, provisions double, net_profit double, total_assets double, equity double")
