from __future__ import annotations

import os
import sys
from datetime import datetime
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from campaign_metrics.schema import RECORDS  # noqa: E402
from campaign_metrics.session import checkpoint_dir, get_session  # noqa: E402

SF_SMOKE = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[8]", app="campaign-metrics-tests", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
    s.stop()


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def record(event_id=1, source_id=1, guid="g", center="C", project=None, when="2026-03-09 10:00:00",
           work_unit="1.0", raw_count=1, seq=0, created=None, description=None):
    t = ts(when)
    return (event_id, source_id, guid, f"{event_id}|{source_id}|{guid}|{when}|{center}|{project}", center, project,
            description, t, Decimal(work_unit), raw_count, None, ts(created) if created else t,
            ts(created) if created else t, (None, None, None, None, seq))


@pytest.fixture
def make_records(spark):
    def make(rows):
        return spark.createDataFrame([record(**r) for r in rows], RECORDS)
    return make
