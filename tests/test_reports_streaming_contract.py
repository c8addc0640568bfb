"""Planning, reports, streaming and the driver contract."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from campaign_metrics.functions.time import ts_literal
from campaign_metrics.operators import adapters, reports
from campaign_metrics.schema import CAMPAIGNS, EVENT_SOURCE, LANDED_PAGE, SOURCES
from campaign_metrics.sources.store import Store
from campaign_metrics.streaming import ingest
from tests.conftest import SF_SMOKE, ts

BASE = dict(slug="s", year=2026, season="spring", starts_at=ts("2026-03-09 00:00:00"),
            ends_at=ts("2026-03-10 00:00:00"), is_public=True, is_live=False, is_archived=False,
            display_alias=None, notes=None)


def _camps(spark, rows):
    return spark.createDataFrame([tuple({**BASE, **r}[f.name] for f in CAMPAIGNS.fields) for r in rows], CAMPAIGNS)


def _sources(spark, rows):
    base = dict(name="Src", slug="src", base_url=None, adapter_type="api_json", supports_weighting=True,
                weight_field=None, is_active=True, notes=None)
    return spark.createDataFrame([tuple({**base, **r}[f.name] for f in SOURCES.fields) for r in rows], SOURCES)


def test_ingest_plan_picks_the_one_active_campaign(spark):
    now = "2026-03-09 12:00:00"
    camps = _camps(spark, [
        dict(event_id=1, slug="live-now", is_live=True),
        dict(event_id=2, slug="live-future", is_live=True, starts_at=ts("2026-03-10 00:00:00"),
             ends_at=ts("2026-03-11 00:00:00")),
        dict(event_id=3, slug="live-past", is_live=True, starts_at=ts("2026-03-01 00:00:00"),
             ends_at=ts("2026-03-02 00:00:00")),
        dict(event_id=4, slug="not-live", is_live=False)])
    bridge = spark.createDataFrame([(i, 1, True) for i in range(1, 5)], EVENT_SOURCE)
    plan = reports.ingest_plan(camps, bridge, _sources(spark, [dict(source_id=1)]), ts_literal(now)).collect()
    assert [(r.event_id, r.source_id) for r in plan] == [(1, 1)]


def test_first_live_public_campaign(spark):
    camps = _camps(spark, [dict(event_id=1, is_archived=True), dict(event_id=2, is_live=True),
                           dict(event_id=3, is_live=True, is_public=False)])
    assert [r.event_id for r in reports.first_live_public(camps).collect()] == [2]


def test_no_data_states_and_countdown(spark, make_records):
    now = ts_literal("2026-03-09 12:00:00")
    camps = _camps(spark, [dict(event_id=1, is_archived=True),
                           dict(event_id=2, is_live=True, starts_at=ts("2026-03-09 10:00:00")),
                           dict(event_id=3, is_live=True, starts_at=ts("2026-03-09 14:25:30")),
                           dict(event_id=4)])
    recs = make_records([dict(event_id=4, guid="x")])
    out = {r.event_id: r for r in reports.no_data_state(camps, recs, now).collect()}
    assert out[1].state == "unavailable" and out[2].state == "waiting"
    assert (out[3].state, out[3].hours, out[3].minutes) == ("countdown", 2, 25)
    assert 4 not in out


def test_slug_suffixes_and_backfill_report(spark):
    camps = _camps(spark, [dict(event_id=1, slug="campaign-2026-spring"), dict(event_id=2, slug=None),
                           dict(event_id=3, slug="old", season=None)])
    out = {r.event_id: r for r in reports.slug_suffixes(camps).collect()}
    assert out[1].new_slug == "campaign-2026-spring" and out[2].new_slug == "campaign-2026-spring-2"
    assert out[3].skipped
    rep = reports.slug_backfill_report(reports.slug_suffixes(camps)).first()
    assert (rep.updated, rep.skipped) == (1, 2)  # one incomplete, one right already


def test_transactions_fall_back_to_record_counts(spark, make_records):
    from campaign_metrics.operators.rollup import hourly_rollup
    camps = _camps(spark, [dict(event_id=1, year=2019, season="fall"), dict(event_id=2, year=2019),
                           dict(event_id=3, year=2018, season=None)])
    recs = make_records([dict(event_id=1, guid="a", raw_count=5), dict(event_id=2, guid="b", raw_count=5),
                         dict(event_id=2, guid="c", raw_count=5)])
    rollup = hourly_rollup(recs.filter("event_id = 1"))
    out = {r.event_id: r for r in reports.transactions_per_campaign(camps, rollup, recs).collect()}
    assert out[1].total_transactions == 5 and out[2].total_transactions == 2 and out[3].total_transactions == 0
    assert [out[i].position for i in (3, 2, 1)] == [1, 2, 3]
    assert (out[1].label, out[3].label) == ("2019 Fall", "2018")
    raw = {r.event_id: r.total_transactions
           for r in reports.transactions_per_campaign(camps, rollup, recs, fallback="raw").collect()}
    assert raw[2] == 10


def _land(spark, path, pages):
    spark.createDataFrame(pages, LANDED_PAGE).write.mode("append").json(path)


def test_stream_replay_is_idempotent_and_late_rows_are_rebucketed(spark):
    root = tempfile.mkdtemp(prefix="cm-stream-")
    landing, store = os.path.join(root, "landing"), Store(spark, os.path.join(root, "store"))
    srcs = _sources(spark, [dict(source_id=1)])
    page = {"data": [{"id": "r1", "center": "A", "timestamp_utc": "2026-03-09T10:15:00Z", "work_unit": 1.5},
                     {"id": "r2", "center": "A", "timestamp_utc": "2026-03-09T10:45:00Z", "work_unit": 2.25}]}
    late = {"data": [{"id": "r0", "center": "A", "timestamp_utc": "2026-03-09T10:05:00Z", "work_unit": 0.25}]}
    bad = {"data": [{"id": "rx", "center": "A", "timestamp_utc": "not a time"}]}
    fetched = ts("2026-03-09 11:00:00")
    now = ts_literal("2026-03-09 12:00:00")
    for pages in ([(1, 1, 0, fetched, json.dumps(page))], [(1, 1, 0, fetched, json.dumps(page))],
                  [(1, 1, 1, fetched, json.dumps(late)), (1, 2, 0, fetched, json.dumps(bad))]):
        _land(spark, landing, pages)
        q = ingest.start_ingest(spark, landing, store, srcs.unionByName(_sources(spark, [dict(source_id=2)])),
                                os.path.join(root, "_chk"), now=now)
        q.awaitTermination()
    recs = store.read("records").collect()
    assert sorted(r.source_guid for r in recs) == ["r0", "r1", "r2"]
    (bucket,) = store.read("rollup").collect()
    assert bucket.weighted_sum == 4 and bucket.raw_sum == 3
    cps = {r.source_id: r for r in store.read("checkpoints").collect()}
    assert cps[1].last_status == "ok" and cps[1].last_seen_timestamp == ts("2026-03-09 10:45:00")
    assert cps[2].last_status == "error" and "unparseable" in cps[2].last_error


def test_unreadable_pages_are_rejects_and_mark_the_pair(spark):
    root = tempfile.mkdtemp(prefix="cm-unreadable-")
    landing, store = os.path.join(root, "landing"), Store(spark, os.path.join(root, "store"))
    srcs = _sources(spark, [dict(source_id=1), dict(source_id=2)])
    good = json.dumps({"data": [{"id": "r1", "center": "A", "timestamp_utc": "2026-03-09T10:15:00Z"}]})
    fetched = ts("2026-03-09 11:00:00")
    pages = [(1, 1, 0, fetched, good), (1, 2, 0, fetched, good), (1, 2, 3, fetched, '{"data": [{"id"'), (1, 2, 4, fetched, '{"a": 1, "a": 2}'),
             (1, 1, 5, fetched, None)]
    _land(spark, landing, pages)
    ingest.start_ingest(spark, landing, store, srcs, os.path.join(root, "_chk"), now=ts_literal("2026-03-09 12:00:00")).awaitTermination()
    cps = {r.source_id: r for r in store.read("checkpoints").collect()}
    assert cps[1].last_status == "ok" and store.read("records").count() == 2
    assert cps[2].last_status == "error" and cps[2].last_error == "unreadable body on page 3"
    typed = spark.createDataFrame(pages, LANDED_PAGE).join(adapters.source_columns(srcs), "source_id", "left")
    assert sorted((r.source_id, r.page_offset, r.reason) for r in adapters.reject_pages(typed).collect()) == [
        (2, 3, "unreadable page"), (2, 4, "unreadable page")]


def test_windows_match_date_trunc(spark, make_records):
    recs = make_records([dict(guid="a", when="2026-03-09 10:15:00"), dict(guid="b", when="2026-03-09 11:59:59")])
    out = sorted(r.bucket.hour for r in ingest.windowed_activity(recs).collect())
    assert out == [10, 11]


def test_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert {"event_id", "center", "bucket", "cumulative_weighted", "cumulative_raw"} <= set(df.columns)
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90
    # Every registered query plans (no action) on the smoke data.
    for name in ("a1_hourly_rollup", "w1_record_running_total", "n6_feed_records", "q7_referential_integrity"):
        assert q[name](spark, SF_SMOKE).schema is not None
    assert F is not None


def test_embed_target_and_public_index(spark, make_records):
    camps = _camps(spark, [dict(event_id=1, is_archived=True, starts_at=ts("2026-03-01 00:00:00")),
                           dict(event_id=2, is_live=True), dict(event_id=3, is_live=True, is_public=False),
                           dict(event_id=4, is_public=True, starts_at=ts("2026-04-01 00:00:00"))])
    recs = make_records([dict(event_id=1, guid="a"), dict(event_id=1, guid="b")])
    (target,) = reports.embed_target(camps, recs).collect()
    assert (target.event_id, target.has_data) == (2, False)
    index = [(r.event_id, r.records_count, r.position) for r in reports.public_index(camps, recs).orderBy("position").collect()]
    assert index == [(4, 0, 1), (2, 0, 2), (1, 2, 3)]
