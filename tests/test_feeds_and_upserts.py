"""Feed adapters, keys and upserts: the reference's literal cases and edge cases."""

from __future__ import annotations

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from campaign_metrics.functions.json_paths import json_path
from campaign_metrics.functions.time import ts_literal
from campaign_metrics.operators import adapters, upsert
from campaign_metrics.schema import LANDED_PAGE, SOURCES
from tests.conftest import ts


def _sources(spark, rows):
    base = dict(name="Src", slug="src", base_url=None, adapter_type="api_json", supports_weighting=True,
                weight_field=None, is_active=True, notes=None)
    return spark.createDataFrame([tuple({**base, **r}[f.name] for f in SOURCES.fields) for r in rows], SOURCES)


def _pages(spark, bodies, source_id=1, event_id=1):
    rows = [(event_id, source_id, i, ts("2026-03-09 12:00:00"), b if isinstance(b, str) else json.dumps(b))
            for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, LANDED_PAGE)


def _records(spark, bodies, **src):
    srcs = _sources(spark, [dict(source_id=1, **src)])
    return adapters.normalize_pages(_pages(spark, bodies), srcs).collect()


def test_biospex_item(spark):
    body = {"items": [{"project": "Herbarium X", "description": "d", "guid": "7d2f1c9e-0000",
                       "timestamp": "2026-03-09T03:36:12.123456Z", "discretionaryState": {"workUnit": 0.5}}]}
    (r,) = _records(spark, [body], adapter_type="biospex_json", name="Notes From Nature")
    assert (r.center, r.project, r.work_unit, r.raw_count) == ("Herbarium X", "Herbarium X", Decimal("0.5000"), 1)
    assert r.timestamp_utc == ts("2026-03-09 03:36:12.123456") and r.source_guid == "7d2f1c9e-0000"


def test_biospex_center_falls_back_to_source_name_and_weight_to_one(spark):
    body = {"items": [{"guid": "g", "timestamp": "2026-03-09T03:36:12+00:00", "project": {"id": 3},
                       "discretionaryState": {"workUnit": "NaN"}},
                      {"guid": "", "timestamp": "2026-03-09T03:36:12+00:00"}]}
    (r,) = _records(spark, [body], adapter_type="biospex_json", name="NfN")
    assert r.project is None and r.work_unit == Decimal("1.0000")


def test_digivol_item_uses_source_name_as_center(spark):
    body = {"items": [{"id": "uuid-1", "project": "Beetles", "description": "x", "timestamp": "2026-03-09T03:36:12Z"}]}
    (r,) = _records(spark, [body], adapter_type="digivol_json", name="DigiVol")
    assert (r.center, r.project, r.work_unit, r.raw_count) == ("DigiVol", "Beetles", Decimal("1.0000"), 1)


def test_digivol_empty_page_yields_nothing(spark):
    assert _records(spark, ["[]", {"items": []}, {"items": "nope"}], adapter_type="digivol_json") == []


def test_weight_field_path(spark):
    body = {"data": [{"guid": "g", "center": "C", "timestamp_utc": "2026-03-09T10:00:00Z", "meta": {"weight": 2.75},
                      "work_unit": 9}]}
    (r,) = _records(spark, [body], weight_field="meta.weight")
    assert r.work_unit == Decimal("2.7500")
    (miss,) = _records(spark, [body], weight_field="meta.other")
    assert miss.work_unit == Decimal("1.0000")   # a miss is 1, no fallback to work_unit


def test_literal_dotted_key_beats_nested_path(spark):
    df = spark.createDataFrame([('{"a.b": 1, "a": {"b": 2}}',), ('{"a": {"b": 2}}',)], "j string")
    assert [r[0] for r in df.select(json_path("j", "a.b")).collect()] == ["1", "2"]


def test_generic_feed_rules(spark):
    body = {"data": [
        {"id": "a-1", "center": "Center A", "project": "P", "timestamp_utc": "2026-03-09T10:00:00Z",
         "work_unit": 1.5, "raw_count": 2},
        {"id": "a-2", "center": "Center B", "timestamp": "2026-03-09T13:00:00+02:00", "workUnit": "abc", "raw_count": 0},
        {"id": "a-3", "timestamp_utc": "2026-03-09T10:00:00Z"},          # no center -> dropped
        "not an object", 42,
    ], "next_page_token": None}
    rows = sorted(_records(spark, [body]), key=lambda r: r.source_guid)
    assert [r.source_guid for r in rows] == ["a-1", "a-2"]
    assert rows[0].work_unit == Decimal("1.5000") and rows[0].raw_count == 2
    assert rows[1].timestamp_utc == ts("2026-03-09 11:00:00")
    assert rows[1].work_unit == Decimal("0.0000") and rows[1].raw_count == 1   # (float)'abc' = 0; count raised to 1


def test_array_key_order_per_family(spark):
    body = {"data": {"not": "an array"}, "items": [{"id": "x", "center": "C", "timestamp": "2026-03-09T10:00:00Z"}]}
    (r,) = _records(spark, [body])
    assert r.source_guid == "x"


def test_bad_timestamp_fails_a_feed_page(spark):
    body = {"data": [{"id": "x", "center": "C", "timestamp": "yesterday-ish"}]}
    with pytest.raises(Exception):
        _records(spark, [body])


def test_unknown_adapter_type_raises(spark):
    with pytest.raises(Exception):
        _records(spark, [{"data": []}], adapter_type="ftp_csv")


def test_same_page_twice_gives_two_rows_and_keeps_created_at(spark):
    body = {"data": [
        {"id": "a-1", "center": "Center A", "timestamp_utc": "2026-03-09T10:00:00Z", "work_unit": 1.5, "raw_count": 2},
        {"id": "a-2", "center": "Center B", "timestamp_utc": "2026-03-09T11:00:00Z", "work_unit": 1}]}
    srcs = _sources(spark, [dict(source_id=1)])
    first = adapters.normalize_pages(_pages(spark, [body]), srcs)
    again = (adapters.normalize_pages(_pages(spark, [body]), srcs)
             .withColumn("ingest_seq", F.col("ingest_seq").withField("pos", F.col("ingest_seq.pos") + 10))
             .withColumn("created_at", ts_literal("2026-03-10 00:00:00"))
             .withColumn("work_unit", F.lit(Decimal("2.2500")).cast("decimal(10,4)")))
    cols = list(upsert.RECORD_COLUMNS)
    merged = upsert.upsert_records(first.select(*cols), again.select(*cols)).collect()
    assert len(merged) == 2 and len({r.dedupe_key for r in merged}) == 2
    assert all(r.work_unit == Decimal("2.2500") for r in merged)
    assert all(r.created_at == ts("2026-03-09 12:00:00") for r in merged)


def test_keep_last_inside_a_batch(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 5, "new"), ("k", 3, "mid"), ("j", 1, "only")],
                               "dedupe_key string, ingest_seq long, v string")
    assert sorted((r.dedupe_key, r.v) for r in upsert.keep_last(df).collect()) == [("j", "only"), ("k", "new")]


def test_checkpoint_advance_ok_and_error(spark):
    cps = spark.createDataFrame([(1, 1, ts("2026-03-09 10:00:00"), "t1", None, "ok", None),
                                 (1, 2, ts("2026-03-09 10:00:00"), "t2", None, "ok", None)],
                                "event_id long, source_id long, last_seen_timestamp timestamp_ntz, last_page_token string,"
                                " last_run_at timestamp_ntz, last_status string, last_error string")
    batch = spark.createDataFrame([(1, 1, ts("2026-03-09 09:00:00"), None, None),
                                   (1, 2, None, None, "x" * 2500),
                                   (1, 3, ts("2026-03-09 11:00:00"), "5", None)],
                                  "event_id long, source_id long, max_ts timestamp_ntz, next_page_token string, error string")
    now = ts_literal("2026-03-09 12:00:00")
    out = {r.source_id: r for r in upsert.advance_checkpoints(cps, batch, now).collect()}
    assert out[1].last_seen_timestamp == ts("2026-03-09 10:00:00") and out[1].last_status == "ok"
    assert out[1].last_page_token is None and out[1].last_run_at == ts("2026-03-09 12:00:00")
    assert out[2].last_status == "error" and len(out[2].last_error) == 2000 and out[2].last_page_token == "t2"
    assert out[3].last_status == "ok" and out[3].last_page_token == "5"


def test_cascade_delete_removes_children(spark, make_records):
    recs = make_records([dict(event_id=1, source_id=1, guid="a"), dict(event_id=1, source_id=2, guid="b"),
                         dict(event_id=2, source_id=1, guid="c")])
    ids = spark.createDataFrame([(1,)], "event_id long")
    left = upsert.cascade_delete({"records": recs}, campaign_ids=ids)
    assert [r.source_guid for r in left["records"].collect()] == ["c"]
    left = upsert.cascade_delete({"records": recs}, source_ids=spark.createDataFrame([(1,)], "source_id long"))
    assert [r.source_guid for r in left["records"].collect()] == ["b"]
