"""Last-wins order over re-fetched pages, opaque next tokens, slugs that already fit."""

import datetime as dt

from campaign_metrics.operators.adapters import normalize_pages
from campaign_metrics.operators.audit import missing_next_pages
from campaign_metrics.operators.reports import slug_backfill_report, slug_suffixes
from campaign_metrics.operators.upsert import keep_last
from campaign_metrics.schema import LANDED_PAGE

SOURCES = "source_id long, adapter_type string, name string, slug string, weight_field string"


def _source(spark):
    return spark.createDataFrame([(1, "api_json", "one", "one", None)], SOURCES)


def _page(offset, minute, weight, more="null"):
    item = f'{{"id":"a","timestamp":"2024-01-01T00:00:00Z","center":"c","workUnit":{weight},"work_unit":{weight}}}'
    return (1, 1, offset, dt.datetime(2024, 1, 2, 0, minute), f'{{"data":[{item}],"next_page_token":{more}}}')


def _pages(spark, rows):
    return spark.createDataFrame([dict(zip([f.name for f in LANDED_PAGE.fields], r)) for r in rows], LANDED_PAGE)


def test_newer_fetch_wins_whatever_its_page(spark):
    rows = [_page(2_000_000, 1, 9.0), _page(1, 5, 3.0)]
    for given in (rows, rows[::-1]):
        kept = keep_last(normalize_pages(_pages(spark, given), _source(spark))).collect()
        assert len(kept) == 1 and kept[0].ingest_seq.page == 1


def test_same_page_fetched_at_the_same_time_has_one_winner(spark):
    rows = [_page(1, 1, 4.0), _page(1, 1, 6.0)]
    seen = {keep_last(normalize_pages(_pages(spark, g), _source(spark))).first().payload_json for g in (rows, rows[::-1])}
    assert len(seen) == 1


def test_opaque_token_expects_the_following_page(spark):
    pages = _pages(spark, [_page(0, 1, 1.0, '"abc=="'), _page(1, 1, 1.0, '"https://x/next?p=2"'), _page(5, 1, 1.0, '""')])
    assert [(r.page_offset, r.expected_next) for r in missing_next_pages(pages, _source(spark)).collect()] == [(1, 2)]


def test_slugs_that_fit_and_blank_seasons_are_skipped(spark):
    rows = [(1, 2024, "fall", None), (2, 2025, " ", "x"), (3, 2026, None, "y")]
    first = slug_suffixes(spark.createDataFrame(rows, "event_id long, year int, season string, slug string"))
    new = {r.event_id: r.new_slug for r in first.collect()}
    assert slug_backfill_report(first).first().asDict() == {"updated": 1, "skipped": 2}
    again = slug_suffixes(spark.createDataFrame([(1, 2024, "fall", new[1])], "event_id long, year int, season string, slug string"))
    assert slug_backfill_report(again).first().asDict() == {"updated": 0, "skipped": 1}
