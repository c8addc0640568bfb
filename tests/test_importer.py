"""Historical CSV import, built from the reference's CSV fixture cases."""

from __future__ import annotations

import csv
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from campaign_metrics.functions.time import ts_literal
from campaign_metrics.operators import importer, reports, upsert
from campaign_metrics.schema import CAMPAIGNS, SOURCES
from campaign_metrics.sources.history import discover_csv_files
from tests.conftest import ts

NOW_TEXT = "2026-06-01 00:00:00"


def _write(base, rel, header, rows):
    path = os.path.join(base, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as fh:
        w = csv.writer(fh, quoting=csv.QUOTE_ALL)
        w.writerow(header)
        w.writerows(rows)


@pytest.fixture(scope="module")
def tree():
    base = tempfile.mkdtemp(prefix="cm-history-")
    _write(base, "2025/newdata/ddf.csv", ["project", "guid", "center"], [["p", "g0", "DigiVol"]])
    _write(base, "2017/newdata/final-cItems.csv", ["description", "guid", "timestamp", "subject.link"],
           [["d1", "c-1", "2017-05-01 10:00:00", "http://x"]])
    _write(base, "2017/newdata/final-sitcItems.csv",
           ["project", "description", "guid", "timestamp", "subject.link", "subject.thumbnailUri",
            "contributor.transcriber"],
           [["Bees, wasps and ants", "d2", "s-1", "2017-05-01T11:00:00+00:00", "l", "t", "someone"]])
    _write(base, "2019/newdata/ddf.csv",
           ["project", "description", "guid", "timestamp", "center", "discretionaryState.workUnit", "id"],
           [["P1", "x", "h-1", "2019-10-18 12:00:00", "Les herbonautes", "3.92", "id-h"],
            ["P2", "y", "", "2019-10-18 13:00:00", "DigiVol", "1", "id-d"],
            ["P3", "z", "n-1", "2019-10-18 14:00:00", "NA", "5d", ""],
            ["P4", "line one\nline two", "n-2", "junk time", "", "1", ""]])
    _write(base, "2020-lite/ddf.csv",
           ["project", "description", "guid", "timestamp", "center", "discretionaryState.workUnit", "ID", "id"],
           [["P", "Smithsonian SITC", "", "2020-04-01 09:00:00", "", "NaN", "ID-1", "id-1"]])
    _write(base, "2016/newdata/final-digItems.csv",
           ["project", "guid", "timestamp", "discretionaryState", "description", "subject.link", "subject.thumbnailUrl"],
           [["Moths", "dv-1", "2016-10-21T10:00:00Z", "{}", "d", "l", "t"],
            ["Moths", "dv-2", "2016-10-21T11:00:00Z", "{}", "d", "l", "t"]])
    _write(base, "2016/newdata/notes.csv", ["guid"], [["ignored"]])
    os.makedirs(os.path.join(base, "empty"), exist_ok=True)
    return base


def _import(spark, base):
    rows = importer.read_history_rows(spark, base)
    dirs = rows.select(F.col("campaign_dir").alias("directory")).distinct()
    existing = spark.createDataFrame([], CAMPAIGNS)
    camps = upsert.upsert_campaigns(existing, reports.directory_campaigns(dirs, ts_literal(NOW_TEXT)))
    by_dir = reports.directory_attributes(dirs, ts_literal(NOW_TEXT)).alias("d").join(
        camps.alias("c"), (F.col("d.year") == F.col("c.year")) & F.col("d.season").eqNullSafe(F.col("c.season")))
    by_dir = by_dir.select(F.col("d.directory").alias("campaign_dir"), "c.event_id", "c.display_alias", "c.slug",
                           "c.year", "c.season")
    srcs = upsert.fill_source_defaults(spark.createDataFrame([], SOURCES), upsert.legacy_source_defaults(spark))
    recs = importer.history_records(rows, by_dir, srcs)
    return rows, camps, srcs, recs


def test_discovery_rules(spark, tree):
    files = {(f.campaign, f.name) for f in discover_csv_files(spark, tree)}
    assert ("2016", "notes.csv") not in files and ("2016", "final-digItems.csv") in files
    assert {c for c, _ in files} == {"2016", "2017", "2019", "2020-lite", "2025"}
    with pytest.raises(FileNotFoundError):
        discover_csv_files(spark, tree, campaign="1999")


def test_records_sources_and_centers(spark, tree):
    rows, camps, srcs, recs = _import(spark, tree)
    slug_of = {r.source_id: r.slug for r in srcs.collect()}
    got = {r.source_guid: r for r in recs.collect()}
    assert slug_of[got["c-1"].source_id] == "citsciscribe"
    assert slug_of[got["s-1"].source_id] == "smithsonian" and got["s-1"].project == "Bees, wasps and ants"
    herb = got["h-1"]
    assert slug_of[herb.source_id] == "les-herbonautes" and herb.work_unit == Decimal("3.9200")
    assert herb.center == "Les herbonautes"
    assert slug_of[got["id-d"].source_id] == "digivol" and got["id-d"].center == "DigiVol"   # guid blank -> id
    assert got["n-1"].work_unit == Decimal("1.0000")            # '5d' is not numeric
    assert got["n-1"].center == "Notes From Nature"             # NA center -> default source label
    assert "n-2" not in got                                     # junk timestamp dropped
    lite = got["id-1"]                                          # ID and id both present: the later 'id' wins
    assert slug_of[lite.source_id] == "smithsonian" and lite.work_unit == Decimal("1.0000")
    assert got["dv-1"].center == "DigiVol"


def test_campaign_attributes_and_stats(spark, tree):
    rows, camps, srcs, recs = _import(spark, tree)
    by_year = {(r.year, r.season): r for r in camps.collect()}
    assert by_year[(2020, "spring")].display_alias == "2020"
    assert by_year[(2025, "spring")].slug == "campaign-2025-spring"
    stats = {r.campaign_dir: r for r in importer.import_stats(rows, recs).collect()}
    assert stats["2025"].records == 0 and "No transcription rows" in stats["2025"].note
    assert stats["2016"].files == 1 and stats["2016"].records == 2
    assert stats["2019"].rows_read == 4 and stats["2019"].records == 3 and stats["2019"].rejected == 1
    labels = {r.event_id: r.display_name for r in reports.campaign_labels(camps).collect()}
    ids = {(r.year, r.season): r.event_id for r in camps.collect()}
    assert labels[ids[(2016, "spring")]] == "Campaign 2016 Spring"


def test_header_forms():
    assert importer.form_index(("ID", "id", "Discretionary State.WorkUnit")) == {
        "ID": 0, "id": 1, "Discretionary State.WorkUnit": 2, "discretionary state.workunit": 2,
        "discretionary_state_workunit": 2}
