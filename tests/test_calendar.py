"""The binned interval join beside every moment held against every entry."""

import math
from datetime import datetime, timedelta

import pytest
from conftest import plan_of

from feedloom.operators.calendar import CALENDAR_DDL, with_boost

START = datetime(2019, 12, 20)
MOMENTS = [(i, START + timedelta(days=i * 3.7)) for i in range(60)] + [(60, None), (61, START), (61, START)]
ENTRIES = [(datetime(2020, 1, 1), 0.5, 2.0), (datetime(2020, 1, 1), 0.5, 2.0), (datetime(2020, 2, 10), -0.3, 9.0),
           (None, 1.0, 1.0), (datetime(2020, 3, 1), None, 1.0), (datetime(2020, 3, 1), 1.0, 0.0), (datetime(2020, 3, 1), 0.2, 0.1)]


@pytest.mark.parametrize("entries", [ENTRIES, []])
def test_beside_all_pairs(spark, entries):
    moments = spark.createDataFrame(MOMENTS, "id INT, at TIMESTAMP_NTZ")
    found = with_boost(moments, "at", spark.createDataFrame(entries, CALENDAR_DDL), bin_days=5).collect()
    assert len(found) == len(MOMENTS)
    for row in found:
        expected = sum(b * math.exp(-0.5 * (abs((row["at"] - h).total_seconds()) // 1 / 86400 / w) ** 2)
                       for h, b, w in entries if row["at"] and h and b is not None and w > 0)
        assert row.boost == pytest.approx(expected, abs=1e-9)


def test_no_nested_loop(spark):
    moments = spark.createDataFrame(MOMENTS, "id INT, at TIMESTAMP_NTZ")
    plan = plan_of(with_boost(moments, "at", spark.createDataFrame(ENTRIES, CALENDAR_DDL)))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
