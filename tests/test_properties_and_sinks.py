"""Replay, permutation and split-batch properties of the upsert (M1) and rollup
(A1), plus the chart sinks (S4, S5)."""

from __future__ import annotations

import json
import os
import random
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from campaign_metrics.functions.time import ts_literal
from campaign_metrics.operators import charts, upsert
from campaign_metrics.operators.rollup import hourly_rollup
from campaign_metrics.schema import CAMPAIGNS, RECORDS
from campaign_metrics.sources import sinks
from tests.conftest import record, ts


def _batch(rnd: random.Random, n: int, seq0: int):
    """Random records over a few keys, so keys repeat inside and across batches."""
    rows = []
    for i in range(n):
        k = rnd.randint(0, 30)
        rows.append(record(event_id=1 + k % 2, source_id=1, guid=f"g{k}", center=f"C{k % 3}",
                           when=f"2026-03-09 1{k % 4}:{k:02d}:00", work_unit=str(rnd.randint(1, 400) / 100),
                           raw_count=rnd.randint(1, 3), seq=seq0 + i))
    return rows


def _state(df):
    return sorted((r.dedupe_key, r.work_unit, r.raw_count, r.ingest_seq) for r in df.collect())


def test_split_batches_equal_one_batch_and_replay_changes_nothing(spark):
    rnd = random.Random(11)
    b1, b2, b3 = _batch(rnd, 40, 0), _batch(rnd, 40, 1000), _batch(rnd, 40, 2000)
    mk = lambda rows: spark.createDataFrame(rows, RECORDS)
    empty = mk([])
    step = empty
    for b in (b1, b2, b3):
        step = upsert.upsert_records(step, mk(b))
    at_once = upsert.upsert_records(empty, mk(b1 + b2 + b3))
    assert _state(step) == _state(at_once)
    replayed = upsert.upsert_records(step, mk(b3))
    assert _state(replayed) == _state(step)
    # A1 over the upserted state does not depend on how the batches were split.
    cols = ["event_id", "bucket_hour_utc", "center", "weighted_sum", "raw_sum"]
    assert sorted(hourly_rollup(step).select(*cols).collect()) == sorted(hourly_rollup(at_once).select(*cols).collect())


def test_row_order_inside_a_batch_does_not_matter(spark):
    rnd = random.Random(5)
    rows = _batch(rnd, 60, 0)
    shuffled = rows[:]
    random.Random(9).shuffle(shuffled)
    a = upsert.keep_last(spark.createDataFrame(rows, RECORDS).repartition(7))
    b = upsert.keep_last(spark.createDataFrame(shuffled, RECORDS).repartition(3))
    assert _state(a) == _state(b)


def _camps(spark):
    base = dict(slug="campaign-2026-spring", year=2026, season="spring", starts_at=ts("2026-03-09 00:00:00"),
                ends_at=ts("2026-03-10 00:00:00"), is_public=True, is_live=False, is_archived=True,
                display_alias=None, notes=None)
    rows = [{**base, "event_id": 1}, {**base, "event_id": 2, "slug": "live", "is_live": True, "is_archived": False}]
    return spark.createDataFrame([tuple(r[f.name] for f in CAMPAIGNS.fields) for r in rows], CAMPAIGNS)


def test_nested_chart_documents_and_writer(spark, make_records):
    recs = make_records([dict(event_id=1, guid="a", center="B", when="2026-03-09 11:00:00"),
                         dict(event_id=1, guid="b", center="A", when="2026-03-09 10:00:00", work_unit="2.5"),
                         dict(event_id=1, guid="c", center="A", when="2026-03-09 11:30:00")])
    now = ts_literal("2026-03-09 12:00:00")
    camps = _camps(spark)
    series = charts.center_running_totals(charts.activity_by_center(recs, hourly_rollup(recs), camps, now))
    docs = sinks.center_documents(charts.chart_meta(camps, now), series)
    (doc,) = [d for d in docs.collect() if d.event_id == 1]
    assert doc.meta.metric_mode == "weighted" and doc.meta.bucket_size == "hour"
    assert [s.center for s in doc.series] == ["A", "B"]
    a_points = doc.series[0].points
    assert [p.hour for p in a_points] == ["2026-03-09T10:00:00+00:00", "2026-03-09T11:00:00+00:00"]
    assert [p.cumulative_weighted for p in a_points] == [Decimal("2.5000"), Decimal("3.5000")]
    out = tempfile.mkdtemp(prefix="cm-charts-")
    sinks.write_chart(docs, os.path.join(out, "by_center"))
    written = [json.loads(line) for f in os.listdir(os.path.join(out, "by_center", "event_id=1"))
               if f.endswith(".json") for line in open(os.path.join(out, "by_center", "event_id=1", f))]
    assert written[0]["series"][0]["center"] == "A"


def test_snapshots_keep_fresh_refresh_stale_and_skip_live(spark, make_records):
    recs = make_records([dict(event_id=1, guid="a"), dict(event_id=2, guid="b")])
    camps = _camps(spark)
    now = ts_literal("2026-03-09 12:00:00")
    charts_by_type = {"hourly": recs.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))}
    prior = spark.createDataFrame([(1, "hourly", "[]", ts("2026-03-09 11:50:00"))],
                                  "event_id long, snapshot_type string, data_json string, generated_at timestamp_ntz")
    kept = {(r.event_id, r.snapshot_type): r for r in sinks.materialize_snapshots(prior, camps, charts_by_type, now)
            .collect()}
    assert kept[(1, "hourly")].generated_at == ts("2026-03-09 11:50:00") and (2, "hourly") not in kept
    stale = prior.withColumn("generated_at", ts_literal("2026-03-09 11:40:00"))
    fresh = {(r.event_id, r.snapshot_type): r for r in sinks.materialize_snapshots(stale, camps, charts_by_type, now)
             .collect()}
    assert fresh[(1, "hourly")].generated_at == ts("2026-03-09 12:00:00") and fresh[(1, "hourly")].points == 1


@pytest.mark.parametrize("grain", ["day", "hour"])
def test_incremental_batches_keep_rollup_equal_to_a_rebuild(spark, grain):
    import tempfile as _tf

    from campaign_metrics.sources.store import Store

    store = Store(spark, os.path.join(_tf.mkdtemp(prefix="cm-apply-"), "store"), slice=grain)
    rnd = random.Random(3)
    mk = lambda rows: spark.createDataFrame(rows, RECORDS)
    batches = [_batch(rnd, 30, 0), _batch(rnd, 30, 1000), _batch(rnd, 30, 2000)]
    for b in batches:
        store.apply_batch(mk(b))
    expected = upsert.upsert_records(mk([]), mk([r for b in batches for r in b]))
    assert _state(store.read("records")) == _state(expected)
    cols = ["event_id", "bucket_hour_utc", "center", "weighted_sum", "raw_sum"]
    stored = sorted(tuple(r) for r in store.read("rollup").select(*cols).collect())
    rebuilt = sorted(tuple(r) for r in hourly_rollup(store.read("records")).select(*cols).collect())
    assert stored == rebuilt
    # First-seen time survives a re-sent key.
    first = {r.dedupe_key: r.created_at for r in mk(batches[0]).collect()}
    now = {r.dedupe_key: r.created_at for r in store.read("records").collect()}
    assert all(now[k] == v for k, v in first.items())


def _rollups(store):
    cols = ["event_id", "bucket_hour_utc", "center", "weighted_sum", "raw_sum"]
    return [sorted(tuple(r) for r in df.select(*cols).collect()) for df in (store.read("rollup"), hourly_rollup(store.read("records")))]


def test_batch_that_died_before_the_rollup_write_converges_when_run_again(spark, tmp_path, monkeypatch):
    from campaign_metrics.sources.store import Store

    store, rnd = Store(spark, str(tmp_path / "store")), random.Random(4)
    first, second = (spark.createDataFrame(_batch(rnd, 30, n), RECORDS) for n in (0, 1000))
    store.apply_batch(first)
    with monkeypatch.context() as m:
        m.setattr(Store, "refresh_rollup", lambda self, touched: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.apply_batch(second)
    store.apply_batch(second)
    stored, rebuilt = _rollups(store)
    assert stored == rebuilt


def test_batch_completes_the_rollup_of_records_stored_without_one(spark, tmp_path):
    from campaign_metrics.sources.store import Store

    store, rnd = Store(spark, str(tmp_path / "store")), random.Random(5)
    first, second = (spark.createDataFrame(_batch(rnd, 30, n), RECORDS) for n in (0, 1000))
    store.append("records", upsert.keep_last(first.select(*upsert.RECORD_COLUMNS)))
    store.apply_batch(second.unionByName(first.limit(0)))
    stored, rebuilt = _rollups(store)
    campaigns = {r.event_id for r in second.collect()}
    assert stored == [r for r in rebuilt if r[0] in campaigns]
