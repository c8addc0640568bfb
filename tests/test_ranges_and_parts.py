"""Row numbers and running sums over sized ranges, chart documents and snapshots in parts, source filter before the parse."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campaign_metrics.functions.time import ts_literal
from campaign_metrics.operators import adapters
from campaign_metrics.operators.running import range_count, running_positions, running_sums
from campaign_metrics.sources import sinks
from tests.conftest import ts
from tests.test_feeds_and_upserts import _pages, _sources


@pytest.mark.parametrize("ranges", [1, 7, None])
def test_positions_equal_the_window_with_a_hot_group(spark, ranges):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 40 + 2).alias("g"), (F.xxhash64("id") % 50).alias("t"), "id")
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")).cast("long"))
    got = running_positions(df, "g", ["t", "id"], num_partitions=ranges)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert running_positions(df.limit(0), "g", ["t", "id"]).collect() == []


def test_the_input_is_written_once_and_read_from_there(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    df = spark.range(1000).select((F.col("id") % 5).alias("g"), "id", F.lit(1.5).cast("decimal(10,4)").alias("w")).mapInArrow(
        seen, "g bigint, id bigint, w decimal(10,4)")
    out = running_sums(df, "g", ["id"], {"w": 4}, num_partitions=4)
    assert calls.value <= 2000  # once to find the ranges, once to deal
    before = calls.value
    assert out.agg(F.max("cumulative_w")).first()[0] == 300 and calls.value == before


def test_range_count_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("x")).write.parquet(path)
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert range_count(df) == cores
    assert range_count(df.alias("a").join(df.alias("b"), "x"), range_bytes=100_000) == pytest.approx(
        2 * range_count(df, range_bytes=100_000), abs=2) and range_count(df, range_bytes=100_000) > cores


def _series(spark):
    rows = [(1, c, ts(f"2026-03-09 {h:02d}:00:00"), float(h), 1) for c in "AB" for h in range(10)] + [(2, "C", ts("2026-03-09 05:00:00"), 2.0, 3)]
    df = spark.createDataFrame(rows, "event_id bigint, center string, bucket timestamp_ntz, weighted double, raw bigint")
    return df.withColumns({"cumulative_weighted": F.col("weighted"), "cumulative_raw": F.col("raw")})


def test_document_parts_in_order(spark):
    parts = sinks.center_document_parts(_series(spark), points=4).collect()
    assert sorted((r.event_id, r.center, r.part, len(r.points)) for r in parts) == [
        *[(1, c, p, n) for c in "AB" for p, n in ((0, 4), (1, 4), (2, 2))], (2, "C", 0, 1)]
    a = [p.hour for r in sorted(parts, key=lambda r: r.part) if r.center == "A" for p in r.points]
    assert a == [f"2026-03-09T{h:02d}:00:00+00:00" for h in range(10)]


def test_snapshot_parts_of_eligible_campaigns(spark):
    camps = spark.createDataFrame([(1, True, False, True), (2, True, False, False)], "event_id bigint, is_archived boolean, is_live boolean, is_public boolean")
    parts = sinks.snapshot_parts(camps, {"by_center": _series(spark)}, ts_literal("2026-03-10 00:00:00"), points=15).collect()
    data = {r.part: json.loads(r.data_json) for r in parts}
    assert {r.event_id for r in parts} == {1} and {k: len(v) for k, v in data.items()} == {0: 15, 1: 5}
    assert [x["center"] for x in data[0][:4]] == ["A", "B", "A", "B"] and "place" not in data[0][0]


def test_pages_of_other_types_are_dropped_before_they_are_parsed(spark):
    body = {"data": [{"id": "a", "center": "C", "timestamp_utc": "2026-03-09T10:00:00Z"}], "items": []}
    pages = _pages(spark, [body], source_id=1).unionByName(_pages(spark, [body], source_id=2))
    srcs = _sources(spark, [dict(source_id=1), dict(source_id=2, adapter_type="biospex_json")])
    assert [r.source_id for r in adapters.normalize_pages(pages, srcs, types=("api_json",)).collect()] == [1]


def test_split_reads_honour_quoted_newlines_where_there_are_some(spark, tmp_path):
    from campaign_metrics.operators.importer import read_history_rows
    from campaign_metrics.sources.history import files_with_open_quotes

    head = "guid,project,description,timestamp,discretionaryState.workUnit\n"
    folder = tmp_path / "2019-fall"
    folder.mkdir()
    (folder / "aItems.csv").write_text(head + 'g1,p,"two\nlines, ""quoted""",2019-10-01 10:00:00,1\ng2,p,plain,2019-10-01 11:00:00,2\n')
    (folder / "bItems.csv").write_text(head + 'g3,p,"one, line ""q""",2019-10-01 10:00:00,1\n' + "".join(
        f"g{k},p,d,2019-10-01 10:00:00,1\n" for k in range(4, 300)))
    assert {f.rsplit("/", 1)[1] for f in files_with_open_quotes(spark, [str(folder / n) for n in ("aItems.csv", "bItems.csv")])} == {"aItems.csv"}
    cols = ["file_name", "source_guid", "description", "work_unit_value"]
    split = sorted(read_history_rows(spark, str(tmp_path), multiline=False).select(*cols).collect(), key=str)
    assert split == sorted(read_history_rows(spark, str(tmp_path)).select(*cols).collect(), key=str)
    assert len(split) == 299 and any(r.description == 'two\nlines, "quoted"' for r in split)
