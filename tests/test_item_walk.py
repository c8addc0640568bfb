"""An item of a landed page is walked once: what its adapter reads are values, and its text is written only if asked for."""

import pytest
from pyspark.sql import functions as F

from campaign_metrics.operators import adapters, pages
from campaign_metrics.schema import SOURCES

ITEMS = [
    '{"id":"a","center":"c","timestamp":"2026-03-09T10:00:00Z","work_unit":2.5,"raw_count":"3","k":7}',
    '{"guid":"b","center":"c","timestamp_utc":"2026-03-09T10:00:00Z","timestamp":"","project":"p","k":{"z":1}}',
    '{"guid":{"n":1},"project":{"name":"q"},"timestamp":"2026-03-09T11:00:00+01:00","discretionaryState":{"workUnit":4}}',
    '{"guid":"d","project.name":"lit","project":{"name":"nested"},"timestamp":"2026-03-09T11:00:00Z","discretionaryState.workUnit":"5"}',
    '{"guid":"e","center":null,"description":[1,2],"subject":"s","timestamp":"2026-03-09T11:00:00Z","workUnit":"1e1"}',
    '{"center":"no id","project":5,"timestamp":"2026-03-09T11:00:00Z","description":"d","rawCount":2.9}',
    '{}', 'null', '7', '"text"', '[{"id":"in array"}]',
]


@pytest.fixture(scope="module")
def landed(spark):
    row = {f.name: None for f in SOURCES.fields}
    kinds = [("api_json", None), ("biospex_json", None), ("digivol_json", None), ("api_json", "k"), ("digivol_json", "k.z")]
    sources = spark.createDataFrame([{**row, "source_id": i, "name": f"n{i}", "slug": f"s{i}", "adapter_type": a, "weight_field": w}
                                     for i, (a, w) in enumerate(kinds)], SOURCES)
    body = '{"items":[' + ",".join(ITEMS) + ']}'
    rows = spark.createDataFrame([(1, i, 0, body) for i in range(len(kinds))], "event_id long, source_id long, page_offset long, body string")
    return rows.withColumn("fetched_at", F.lit("2026-03-09 12:00:00").cast("timestamp_ntz")), sources


def test_judged_items_are_those_of_the_exploded_path(landed):
    cols = ["source_id", "source_guid", "center", "project", "description", "timestamp_utc", "work_unit", "raw_count", "payload_json"]
    got = pages.good_records(pages.judge_pages(*landed)).select(*cols)
    want = adapters.normalize_pages(*landed).select(*cols)
    assert got.count() > 15
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_without_payload_only_the_text_is_missing(landed):
    rest = [c for c in pages.good_records(pages.judge_pages(*landed)).columns if c != "payload_json"]
    full, bare = (pages.judge_pages(*landed, payload=p) for p in (True, False))
    assert sorted(map(str, pages.good_records(full).select(rest).collect())) == sorted(map(str, pages.good_records(bare).select(rest).collect()))
    assert pages.good_records(bare).filter("payload_json is not null").count() == 0
    assert [r.items_read for r in bare.select("items_read").collect()] == [7] * 5


def test_mapping_reads_no_path_twice(landed):
    plan = pages.judge_pages(*landed).select("items")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$['center']") == 0 and plan.count("$['timestamp']") == 0  # literal keys come from the one walk
