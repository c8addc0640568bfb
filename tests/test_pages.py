"""Landed pages as wholes: verdicts, quarantine, states, token walks, the stream over faulty landings, adapter registration."""

from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from campaign_metrics.functions.json_paths import variant_path
from campaign_metrics.functions.time import ts_literal
from campaign_metrics.operators import adapters, audit, pages
from campaign_metrics.schema import CHECKPOINTS, LANDED_PAGE
from campaign_metrics.sources import feeds
from campaign_metrics.sources.store import Store
from campaign_metrics.streaming import ingest
from tests.conftest import ts
from tests.test_feeds_and_upserts import _sources

AT = "2026-03-09T11:00:00"


def _item(k, when="2026-03-09T10:15:00Z", **more):
    return {"id": f"r{k}", "center": "A", "timestamp_utc": when, **more}


def _line(source, offset, body, at=AT, **more):
    return json.dumps({"event_id": 1, "source_id": source, "page_offset": offset, "fetched_at": at,
                       "body": body if body is None or isinstance(body, str) else json.dumps(body), **more})


def _land(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(lines) + "\n")


LINES = [
    _line(1, 0, {"data": [_item(1), _item(2)]}),
    _line(1, 1, {"data": [_item(3)]})[:50],                                     # cut off
    '{"event_id": 1, "source_id": "one", "page_offset": 2}',                    # other types
    _line(9, 0, {"data": [_item(4)]}),                                          # no such source
    _line(3, 0, {"data": [_item(5)]}),                                          # a type nobody registered
    _line(1, 3, '{"data": [], "data": []}'),                                    # a key given twice
    _line(1, 4, '{"data": [{"id"'),                                             # no JSON
    _line(1, 5, {"data": [_item(6), _item(7, when="not a time")]}),
    _line(1, 6, {"data": [_item(8, work_unit=1e9)]}),
    _line(1, 7, {"data": [_item(9, raw_count=40000)]}),
    _line(1, 8, {"data": [_item(10, work_unit="1e400")]}),
    _line(1, 9, {"data": [_item(11, when=None), {"id": "no center", "timestamp_utc": "junk"}, "no object"]}),  # dropped items do not count
    _line(2, 0, {"data": []}), _line(2, 1, None), _line(2, 2, {"other": 1}),    # no records, all good
]


@pytest.fixture
def landed(spark):
    path = tempfile.mkdtemp(prefix="cm-pages-")
    _land(path, "a.json", LINES)
    sources = _sources(spark, [dict(source_id=1), dict(source_id=2), dict(source_id=3, adapter_type="ftp_csv")])
    return path, sources


def test_every_fault_quarantines_its_page_whole(spark, landed):
    path, sources = landed
    judged = pages.judge_pages(feeds.read_feed_pages(spark, path), sources)
    rows = pages.quarantined_pages(judged).collect()
    reasons = sorted(((r.source_id, r.page_offset, r.reason) for r in rows), key=str)
    assert reasons == sorted([
        (None, None, "broken line"), (None, 2, "broken line"), (9, 0, "unknown source"), (3, 0, "unknown adapter type"),
        (1, 3, "repeated key"), (1, 4, "unreadable body"), (1, 5, "unparseable timestamp"), (1, 6, "value out of range"),
        (1, 7, "value out of range"), (1, 8, "value out of range")], key=str)
    assert sorted(r.text for r in rows if r.reason == "broken line") == sorted(LINES[1:3])
    assert [r.text for r in rows if r.reason == "unreadable body"] == ['{"data": [{"id"']
    recs = pages.good_records(judged).collect()
    assert sorted(r.source_guid for r in recs) == ["r1", "r2"]
    counts = {(r.source_id, r.page_offset): (r.items_read, r.items_kept) for r in judged.collect()}
    assert counts[1, 9] == (2, 0) and counts[1, 0] == (2, 2) and counts[2, 1] == counts[2, 2] == (0, 0)


def test_records_are_those_of_the_batch_path(spark, landed):
    path, sources = landed
    good = feeds.read_feed_pages(spark, path).filter("source_id = 1 and page_offset = 0")
    cols = ["dedupe_key", "source_guid", "center", "timestamp_utc", "work_unit", "raw_count", "payload_json", "created_at"]
    mine = pages.good_records(pages.judge_pages(good, sources)).select(*cols).collect()
    assert sorted(mine) == sorted(adapters.normalize_pages(good, sources).select(*cols).collect())


def test_page_states(spark, landed):
    path, sources = landed
    states = {r.source_id: r for r in pages.page_states(pages.judge_pages(feeds.read_feed_pages(spark, path), sources)).collect()}
    assert sorted(states) == [1, 2, 3]  # nothing is kept for an unknown source
    assert (states[1].pages_ok, states[1].max_ts, states[1].error) == (2, ts("2026-03-09 10:15:00"), "repeated key on page 3")
    assert (states[2].pages_ok, states[2].max_ts, states[2].error) == (3, None, None)
    assert (states[3].pages_ok, states[3].error) == (0, "unknown adapter type on page 0")


def test_a_later_good_fetch_clears_the_error_and_keeps_the_token(spark):
    sources = _sources(spark, [dict(source_id=1)])
    rows = [(1, 1, 0, ts("2026-03-09 11:00:00"), json.dumps({"data": [_item(1)], "meta": {"next_page_token": "tok-1"}})),
            (1, 1, 1, ts("2026-03-09 11:01:00"), "broken")]
    first = pages.page_states(pages.judge_pages(spark.createDataFrame(rows, LANDED_PAGE), sources))
    stored = pages.advance_by_pages(spark.createDataFrame([], CHECKPOINTS), first, ts_literal("2026-03-09 12:00:00"))
    (cp,) = stored.collect()
    assert (cp.last_status, cp.last_error, cp.last_page_token) == ("error", "unreadable body on page 1", "tok-1")
    assert cp.last_seen_timestamp == ts("2026-03-09 10:15:00")  # good pages advance the cursor
    later = [(1, 1, 1, ts("2026-03-09 11:05:00"), json.dumps({"data": []}))]
    states = pages.page_states(pages.judge_pages(spark.createDataFrame(rows[1:] + later, LANDED_PAGE), sources))
    (cp,) = pages.advance_by_pages(stored, states, ts_literal("2026-03-09 13:00:00")).collect()
    assert (cp.last_status, cp.last_error, cp.last_page_token, cp.last_run_at) == ("ok", None, None, ts("2026-03-09 13:00:00"))
    assert cp.last_seen_timestamp == ts("2026-03-09 10:15:00")
    failed = pages.page_states(pages.judge_pages(spark.createDataFrame(rows[1:], LANDED_PAGE), sources))
    (cp,) = pages.advance_by_pages(stored, failed, ts_literal("2026-03-09 14:00:00")).collect()
    assert (cp.last_status, cp.last_page_token) == ("error", "tok-1")  # without a good page the token stays


def test_the_stream_survives_faulty_lines_and_keeps_them(spark, landed):
    path, sources = landed
    root = tempfile.mkdtemp(prefix="cm-faulty-")
    store = Store(spark, os.path.join(root, "store"))
    run = lambda: ingest.start_ingest(spark, path, store, sources, os.path.join(root, "_chk"), now=ts_literal("2026-03-09 12:00:00")).awaitTermination()
    run()
    assert store.read("records").count() == 2 and store.read("quarantine").count() == 10
    cps = {r.source_id: (r.last_status, r.last_run_at is not None) for r in store.read("checkpoints").collect()}
    assert cps == {1: ("error", True), 2: ("ok", True), 3: ("error", True)}
    _land(path, "b.json", [_line(1, 10, {"data": [_item(20, when="2026-03-09T11:15:00Z")], "next_page_token": "t11"}, at="2026-03-09T12:00:00"), "{"])
    run()
    cp = {r.source_id: r for r in store.read("checkpoints").collect()}[1]
    assert (cp.last_status, cp.last_page_token, cp.last_seen_timestamp) == ("ok", "t11", ts("2026-03-09 11:15:00"))
    assert store.read("records").count() == 3 and store.read("quarantine").count() == 11


def _walk(spark, rows, **source):
    df = spark.createDataFrame([(1, 1, o, ts(at), json.dumps(b) if not isinstance(b, str) else b, t) for o, t, b, at in rows],
                               "event_id bigint, source_id bigint, page_offset bigint, fetched_at timestamp_ntz, body string, page_token string")
    out = audit.walk_pages(df, _sources(spark, [dict(source_id=1, **source)])).collect()
    return sorted((r.token, r.status) for r in out)


def test_walk_over_opaque_tokens(spark):
    at = "2026-03-09 11:00:00"
    page = lambda nxt: {"data": [_item(1)], "next_page_token": nxt}
    chain = [(0, None, page("a"), at)] + [(k, t, page(n), at) for k, (t, n) in enumerate(zip("abcdefg", "bcdefgh"), 1)]
    assert _walk(spark, chain) == sorted([("", "reached"), *((t, "reached") for t in "abcdefg"), ("h", "missing")])
    without = [r for r in chain if r[1] != "c"]
    assert _walk(spark, without) == sorted([("", "reached"), ("a", "reached"), ("b", "reached"), ("c", "missing"),
                                            *((t, "unreachable") for t in "defg")])
    loop = [(0, None, page("a"), at), (1, "a", page("b"), at), (2, "b", page("a"), at)]
    assert _walk(spark, loop) == [("", "reached"), ("a", "reached"), ("b", "reached")]
    again = [(0, None, page("x"), at), (0, None, page("a"), "2026-03-09 12:00:00"), (1, "a", page(None), at)]
    assert _walk(spark, again) == [("", "reached"), ("a", "reached")]  # the latest fetch counts
    broken = [(0, None, page("a"), at), (1, "a", '{"data"', at), (2, "b", page(None), at)]
    assert _walk(spark, broken) == [("", "reached"), ("a", "quarantined"), ("b", "unreachable")]


def test_walk_over_offsets(spark):
    at = "2026-03-09 11:00:00"
    page = lambda start: {"items": [], "start": start, "rows": 100, "numFound": 350}
    rows = [(k, None, page(100 * k), at) for k in (0, 1, 3)]
    assert _walk(spark, rows, adapter_type="biospex_json") == [("", "reached"), ("100", "reached"), ("200", "missing"), ("300", "unreachable")]


def test_a_registered_adapter_is_read(spark):
    def mapping(v, item):
        when = variant_path(v, "when")
        text = lambda c: F.lit(c).cast("string")
        return {"ts_text": when, "center": variant_path(v, "where"), "keep": when.isNotNull(), "source_guid": variant_path(v, "key"),
                "project": text(None), "description": text(None), "work_unit": F.lit(2.0), "raw_count": F.lit(1).cast("long")}

    try:
        adapters.register_adapter("atom", ("atom_json",), ("entries",), mapping)
        with pytest.raises(ValueError):
            adapters.register_adapter("other", ("api_json",), ("data",), mapping)
        sources = _sources(spark, [dict(source_id=1, adapter_type="atom_json"), dict(source_id=2)])
        body = json.dumps({"entries": [{"key": "k1", "where": "X", "when": "2026-03-09T10:00:00Z"}, {"key": "k2"}], "next_page_token": "n"})
        df = spark.createDataFrame([(1, 1, 0, ts("2026-03-09 11:00:00"), body), (1, 2, 0, ts("2026-03-09 11:00:00"), json.dumps({"data": [_item(1)]}))],
                                   LANDED_PAGE)
        judged = pages.judge_pages(df, sources)
        recs = {r.source_guid: r for r in pages.good_records(judged).collect()}
        assert sorted(recs) == ["k1", "r1"] and recs["k1"].center == "X" and recs["k1"].work_unit == 2
        assert {r.source_id: r.next_token for r in judged.collect()} == {1: "n", 2: None}
        assert sorted(r.source_guid for r in adapters.normalize_pages(df, sources).collect()) == ["k1", "r1"]
    finally:
        for registry in (feeds.FAMILIES, adapters.ADAPTERS, adapters.NEXT_TOKENS, adapters.OWN_TOKENS):
            registry.pop("atom", None)


def test_windows_count_records_that_land_twice_once(spark):
    root = tempfile.mkdtemp(prefix="cm-windows-")
    landing, out = os.path.join(root, "landing"), os.path.join(root, "out")
    sources = _sources(spark, [dict(source_id=1)])
    run = lambda: ingest.start_window_changes(spark, landing, sources, out, os.path.join(root, "_chk")).awaitTermination()
    _land(landing, "a.json", [_line(1, 0, {"data": [_item(1), _item(2, when="2026-03-09T12:15:00Z"), _item(1)]}), "{"])
    run()
    _land(landing, "b.json", [_line(1, 0, {"data": [_item(1), _item(2, when="2026-03-09T12:15:00Z")]}),
                              _line(1, 1, {"data": [_item(3, when="2026-03-09T12:45:00Z")]})])
    run()
    assert sorted((r.bucket.hour, r.raw) for r in ingest.read_windows(spark, out).collect()) == [(10, 1), (12, 2)]
    assert sorted((r.batch, r.bucket.hour) for r in spark.read.parquet(out).collect()) == [(0, 10), (0, 12), (1, 12)]
    ingest.compact_windows(spark, out, out + "-compact")
    assert sorted((r.bucket.hour, r.raw) for r in ingest.read_windows(spark, out + "-compact").collect()) == [(10, 1), (12, 2)]
