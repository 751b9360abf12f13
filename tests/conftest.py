from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from skywarden import schema as S  # noqa: E402
from skywarden.session import build_session  # noqa: E402

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frames(spark):
    """Build packets from dicts; ``at`` is seconds after the start, everything not given is null."""
    names = spark.createDataFrame([], S.PACKETS).columns

    def build(rows: list[dict]):
        full = []
        for i, row in enumerate(rows):
            row = {"packet_id": i, "sensor_id": "s", "packet_size": 100, **row}
            row["ts"] = START + dt.timedelta(microseconds=round(row.pop("at") * 1_000_000))
            full.append(tuple(row.get(n) for n in names))
        return spark.createDataFrame(full, S.PACKETS)
    return build
