"""Rows that are written once are not shuffled or rewritten without need: running sums, replays."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from campaign_metrics.operators.running import running_sums
from campaign_metrics.operators.upsert import RECORD_COLUMNS, record_digest
from campaign_metrics.sources.store import Store


def _files(store):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(store.path("records")) for f in names if f.endswith(".parquet"))


def test_offsets_are_joined_without_a_shuffle_of_the_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", F.lit(1).alias("v"))
    out = running_sums(df, "g", ["id"], {"v": 0}, num_partitions=4)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.cumulative_v for r in out.filter("g = 1").collect()) == list(range(1, 334))


def test_a_replay_rewrites_no_file_and_a_change_only_its_partition(spark, make_records, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [dict(guid=f"r{i}", when=f"2026-03-{9 + i % 2:02d} 10:00:00", seq=i) for i in range(6)]
    store.apply_batch(make_records(rows))
    first = _files(store)
    store.apply_batch(make_records(rows + [dict(guid="new", when="2026-03-09 10:00:00", seq=9)]))
    assert set(first) < set(_files(store)) and store.read("records").count() == 7
    assert store.read("rollup").agg(F.sum("raw_sum")).first()[0] == 7
    second = _files(store)
    store.apply_batch(make_records([{**rows[1], "work_unit": "5.0", "created": "2026-05-01 00:00:00", "seq": 10},
                                    {**rows[0], "seq": 0}, dict(guid="more", when="2026-03-10 10:00:00", seq=11)]))
    gone = {re.search(r"time_slice=([0-9-]+)", f)[1] for f in set(second) - set(_files(store))}
    assert gone == {"2026-03-10"}
    got = {r.source_guid: r for r in store.read("records").collect()}
    assert len(got) == 8 and store.read("records").count() == 8
    assert str(got["r1"].work_unit) == "5.0000" and str(got["r1"].created_at) == "2026-03-10 10:00:00"


def test_digest_tells_every_column_but_the_first_seen_time(spark, make_records):
    def digest(**more):
        return bytes(make_records([dict(guid="a", **more)]).select(*RECORD_COLUMNS).select(record_digest()).first()[0])

    assert digest() != digest(project="x") != digest(description="x")
    assert digest() != digest(work_unit="1.0001") and digest() != digest(seq=1) and digest() != digest(raw_count=2)


def test_a_batch_of_new_keys_is_not_digested_and_read_back_from_its_folder(spark, make_records, tmp_path, monkeypatch):
    store, plans, apply = Store(spark, str(tmp_path / "s")), [], Store._apply
    monkeypatch.setattr(Store, "_apply", lambda self, new: (plans.append(new.inputFiles()), apply(self, new)))
    monkeypatch.setattr("campaign_metrics.operators.upsert.record_digest", lambda: 1 / 0)
    store.apply_batch(make_records([dict(guid="a", seq=1), dict(guid="a", seq=2, work_unit="3.0"), dict(guid="b", seq=3)]))
    store.apply_batch(make_records([dict(guid="c", seq=4)]))
    assert sorted((r.source_guid, str(r.work_unit)) for r in store.read("records").collect()) == [
        ("a", "3.0000"), ("b", "1.0000"), ("c", "1.0000")]
    assert store.read("rollup").agg(F.sum("raw_sum")).first()[0] == 3
    assert len(plans) == 2 and all("stage-batch" in f for files in plans for f in files) and all(plans)
    assert not any(os.path.exists(f.removeprefix("file://")) for files in plans for f in files)
