"""Landed pages are parsed once, whatever is asked of their verdicts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from campaign_metrics.functions.text import blank
from campaign_metrics.operators import adapters, pages
from campaign_metrics.schema import LANDED_PAGE
from tests.conftest import ts
from tests.test_feeds_and_upserts import _sources

BODY = '{"data": [{"id": "a", "center": "A", "timestamp": "2026-03-09T10:15:00Z"}, "no object", "{", null, [1], 1.5]}'


def _judged(spark, body=BODY):
    rows = [(1, 1, 0, ts("2026-03-09 11:00:00"), body)]
    return pages.judge_pages(spark.createDataFrame(rows, LANDED_PAGE), _sources(spark, [dict(source_id=1)]))


@pytest.mark.parametrize("ask", [pages.quarantined_pages, pages.page_states, pages.good_records])
def test_a_page_is_parsed_once(spark, ask):
    plan = ask(_judged(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1, plan
    assert plan.count("$['timestamp_utc']") == _judged(spark)._jdf.queryExecution().optimizedPlan().toString().count("$['timestamp_utc']")


def test_only_objects_are_items(spark):
    (page,) = _judged(spark).collect()
    assert (page.items_read, page.items_kept, page.reason) == (1, 1, None)


def test_a_pair_with_pages_of_no_source_has_no_state(spark):
    rows = [(1, 9, 0, ts("2026-03-09 11:00:00"), BODY), (1, 1, 0, ts("2026-03-09 11:00:00"), "broken")]
    judged = pages.judge_pages(spark.createDataFrame(rows, LANDED_PAGE), _sources(spark, [dict(source_id=1)]))
    (state,) = pages.page_states(judged).collect()
    assert (state.source_id, state.pages_ok, state.error) == (1, 0, "unreadable body on page 0")
    assert sorted((r.source_id, r.reason) for r in pages.quarantined_pages(judged).collect()) == [
        (1, "unreadable body"), (9, "unknown source")]


def test_casts_and_blanks_keep_their_values(spark):
    texts = [None, "", " ", "\x0b", "x", "2.9", "-2.9", " 7 rows", "1e3x", ".5", "5.", "1e400", "-1e400", "99999999999999999999"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("t", blank("t").alias("b"), adapters.php_float(F.col("t"), 1.5).alias("f"),
                    adapters.php_int(F.col("t"), 3).alias("n")).orderBy("i").collect()
    assert [r.b for r in got] == [True] * 4 + [False] * 10
    assert [r.f for r in got] == [1.5, 0.0, 0.0, 0.0, 0.0, 2.9, -2.9, 7.0, 1000.0, 0.5, 5.0, float("inf"), float("-inf"), 1e20]
    big = 2 ** 63 - 1
    assert [r.n for r in got] == [3, 0, 0, 0, 0, 2, -2, 7, 1000, 0, 5, big, -big - 1, big]
