"""Rollup and chart series: the reference's literal cases plus the untested ones."""

from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campaign_metrics.functions.time import bucket_size, ts_literal
from campaign_metrics.operators import charts
from campaign_metrics.operators.rollup import hourly_rollup, rollup_or_raw
from campaign_metrics.operators.running import running_sums
from campaign_metrics.schema import CAMPAIGNS
from tests.conftest import ts


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_two_hour_buckets_and_rerun_is_stable(make_records):
    recs = make_records([
        dict(guid="a", center="NHML", when="2026-03-09 10:15:00", work_unit="1.5"),
        dict(guid="b", center="NHML", when="2026-03-09 10:45:00", work_unit="0.5"),
        dict(guid="c", center="NHML", when="2026-03-09 11:05:00", work_unit="1.0"),
    ])
    first = _rows(hourly_rollup(recs), "bucket_hour_utc", "weighted_sum", "raw_sum")
    assert first == [(ts("2026-03-09 10:00:00"), Decimal("2.0000"), 2), (ts("2026-03-09 11:00:00"), Decimal("1.0000"), 1)]
    assert _rows(hourly_rollup(recs), "bucket_hour_utc", "weighted_sum", "raw_sum") == first


def test_fractions_sum_exactly(make_records):
    recs = make_records([
        dict(guid="a", center="Lab A", when="2026-03-09 10:15:00", work_unit="1.5"),
        dict(guid="b", center="Lab A", when="2026-03-09 10:45:00", work_unit="2.25", raw_count=2),
        dict(guid="c", center="Lab A", when="2026-03-09 10:59:00", work_unit="0.75"),
    ])
    (row,) = hourly_rollup(recs).collect()
    assert row.weighted_sum == Decimal("4.5000") and row.raw_sum == 4


def test_grid_of_three_centers_by_four_hours(make_records):
    rows = [dict(guid=f"{c}{h}", center=c, when=f"2026-03-09 1{h}:30:00") for c in "XYZ" for h in range(4)]
    out = hourly_rollup(make_records(rows)).collect()
    assert len(out) == 12 and all(r.weighted_sum == Decimal("1.0000") and r.raw_sum == 1 for r in out)


def _campaigns(spark, rows):
    base = dict(slug="s", year=2026, season="spring", starts_at=ts("2026-03-09 00:00:00"),
                ends_at=ts("2026-03-10 00:00:00"), is_public=True, is_live=False, is_archived=True,
                display_alias=None, notes=None)
    data = []
    for r in rows:
        d = {**base, **r}
        data.append(tuple(d[f.name] for f in CAMPAIGNS.fields))
    return spark.createDataFrame(data, CAMPAIGNS)


def test_rollup_or_raw_mixes_campaigns(make_records):
    recs = make_records([
        dict(event_id=1, guid="a", when="2026-03-09 10:15:00"),
        dict(event_id=2, guid="b", when="2026-03-09 10:15:00", work_unit="2.5", raw_count=3),
    ])
    stored = hourly_rollup(recs.filter("event_id = 1"))
    out = _rows(rollup_or_raw(stored, recs), "event_id", "weighted_sum")
    assert out == [(1, Decimal("1.0000")), (2, Decimal("2.5000"))]


def test_live_minute_buckets_at_the_edges(spark):
    starts = "2026-03-09 12:00:00"
    camp = _campaigns(spark, [dict(event_id=1, is_live=True, starts_at=ts(starts))])
    got = {}
    for now, label in [("2026-03-09 11:59:00", -1), ("2026-03-09 12:59:00", 59),
                       ("2026-03-09 13:00:00", 60), ("2026-03-09 13:01:00", 61)]:
        got[label] = camp.select(bucket_size(F.col("is_live"), F.col("starts_at"), ts_literal(now))).first()[0]
    assert got == {-1: "minute", 59: "minute", 60: "hour", 61: "hour"}
    not_live = _campaigns(spark, [dict(event_id=1, is_live=False, starts_at=ts(starts))])
    assert not_live.select(bucket_size(F.col("is_live"), F.col("starts_at"),
                                       ts_literal("2026-03-09 12:10:00"))).first()[0] == "hour"


def test_live_campaign_charts_by_first_ingest_time_in_minutes(spark, make_records):
    camp = _campaigns(spark, [dict(event_id=1, is_live=True, is_archived=False, starts_at=ts("2026-03-09 10:00:00"))])
    recs = make_records([
        dict(guid="a", when="2026-03-09 08:00:00", created="2026-03-09 10:05:10"),
        dict(guid="b", when="2026-03-09 08:30:00", created="2026-03-09 10:05:50", work_unit="2.0"),
        dict(guid="c", when="2026-03-09 09:00:00", created="2026-03-09 10:07:00"),
    ])
    rollup = hourly_rollup(recs.limit(0))
    out = _rows(charts.activity_per_bucket(recs, rollup, camp, ts_literal("2026-03-09 10:30:00")), "bucket", "weighted")
    assert out == [(ts("2026-03-09 10:05:00"), Decimal("3.0000")), (ts("2026-03-09 10:07:00"), Decimal("1.0000"))]


def test_summary_gives_zeros_for_a_campaign_without_records(spark, make_records):
    camp = _campaigns(spark, [dict(event_id=1), dict(event_id=2)])
    recs = make_records([dict(event_id=1, guid="a", work_unit="2.5", raw_count=3)])
    rows = {r.event_id: r for r in charts.campaign_summary(recs, camp).collect()}
    assert rows[1].weighted_total == Decimal("2.5000") and rows[1].raw_total == 3 and rows[1].center_count == 1
    assert rows[2].weighted_total == 0 and rows[2].raw_total == 0 and rows[2].first_timestamp is None


def test_running_total_breaks_time_ties_by_key(spark, make_records):
    camp = _campaigns(spark, [dict(event_id=1)])
    recs = make_records([dict(guid=g, when="2026-03-09 10:00:00", work_unit=w)
                         for g, w in [("b", "2.0"), ("a", "1.0"), ("c", "4.0")]])
    out = charts.record_running_totals(recs, camp).orderBy("cumulative_raw").collect()
    keys = [r.dedupe_key for r in out]
    assert keys == sorted(keys)
    assert [r.cumulative_raw for r in out] == [1, 2, 3]


def test_distributed_running_sum_matches_window_with_a_hot_group(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(6000):
        g = 0 if i % 3 == 0 else rnd.randint(1, 40)   # group 0 holds a third of all rows
        rows.append((g, rnd.randint(0, 500), f"k{i:05d}", Decimal(rnd.randint(0, 99999)) / Decimal(10000), rnd.randint(1, 5)))
    df = spark.createDataFrame(rows, "g long, t long, key string, w decimal(10,4), r long")
    fast = running_sums(df, "g", ["t", "key"], {"w": 4, "r": 0}, num_partitions=16)
    w = Window.partitionBy("g").orderBy("t", "key").rowsBetween(Window.unboundedPreceding, 0)
    slow = df.select("key", F.sum("w").over(w).alias("cw"), F.sum("r").over(w).alias("cr"))
    a = {r.key: (r.cumulative_w, r.cumulative_r) for r in fast.collect()}
    b = {r.key: (r.cw, r.cr) for r in slow.collect()}
    assert a == b


def test_single_point_series_are_padded(spark):
    df = spark.createDataFrame(
        [(1, "A", ts("2026-03-09 10:00:00"), Decimal("1.5"), 2), (1, "B", ts("2026-03-09 10:00:00"), Decimal("1.0"), 1),
         (1, "B", ts("2026-03-09 11:00:00"), Decimal("1.0"), 1)],
        "event_id long, center string, bucket timestamp_ntz, weighted decimal(20,4), raw long")
    series = charts.center_running_totals(df)
    padded = charts.pad_single_points(series, ["event_id", "center"],
                                      ["weighted", "raw", "cumulative_weighted", "cumulative_raw"])
    a = _rows(padded.filter("center = 'A'"), "bucket", "weighted", "cumulative_weighted")
    assert a == [(ts("2026-03-09 09:00:00"), Decimal("0"), Decimal("0")),
                 (ts("2026-03-09 10:00:00"), Decimal("1.5000"), Decimal("1.5000"))]
    assert padded.filter("center = 'B'").count() == 2
    matrix = charts.center_hour_matrix(padded).orderBy("bucket").collect()
    assert [(r.bucket.hour, r.A, r.B) for r in matrix] == [(9, Decimal("0"), None), (10, Decimal("1.5"), Decimal("1.0")),
                                                           (11, None, Decimal("2.0"))]
