"""End-to-end jobs: historical import into a store, re-aggregation, slugs, health."""

from __future__ import annotations

import os
import tempfile
from decimal import Decimal

from campaign_metrics.plans import jobs
from campaign_metrics.sources.store import Store
from tests.conftest import ts
from tests.test_importer import _write


def test_import_history_end_to_end(spark):
    base = tempfile.mkdtemp(prefix="cm-jobs-")
    _write(base, "2016/newdata/final-digItems.csv", ["project", "guid", "timestamp", "description"],
           [["Moths", "dv-1", "2016-10-21T10:00:00Z", "d"], ["Moths", "dv-2", "2016-10-21T11:00:00Z", "d"]])
    # The same record in ddf.csv and final-digItems.csv (same campaign, source, guid, time,
    # center, project): the later file in name order wins.
    _write(base, "2019/newdata/ddf.csv",
           ["project", "description", "guid", "timestamp", "center", "discretionaryState.workUnit"],
           [["Moths", "x", "dup-1", "2019-10-18 12:00:00", "DigiVol", "1.5"],
            ["P2", "y", "h-1", "2019-10-18 13:30:00", "Les herbonautes", "3.92"]])
    _write(base, "2019/newdata/final-digItems.csv",
           ["project", "guid", "timestamp", "discretionaryState.workUnit"],
           [["Moths", "dup-1", "2019-10-18 12:00:00", "2.5"]])
    _write(base, "2025/newdata/ddf.csv", ["project", "guid", "center"], [["p", "g0", "DigiVol"]])
    store = Store(spark, os.path.join(tempfile.mkdtemp(prefix="cm-store-"), "store"))
    stats = {r.campaign_dir: r for r in jobs.import_history(spark, base, store, now="2026-06-01 00:00:00").collect()}
    assert stats["2019"].records == 3 and stats["2025"].records == 0

    recs = {r.source_guid: r for r in store.read("records").collect()}
    assert set(recs) == {"dv-1", "dv-2", "dup-1", "h-1"}
    assert recs["dup-1"].work_unit == Decimal("2.5000")          # later file wins
    camps = {r.year: r for r in store.read("campaigns").collect()}
    assert camps[2016].starts_at == ts("2016-10-21 10:00:00") and camps[2016].ends_at == ts("2016-10-21 11:00:00")
    assert camps[2025].starts_at == ts("2025-01-01 00:00:00") and "No transcription rows" in camps[2025].notes
    rollup = store.read("rollup").collect()
    assert len(rollup) == 4 and sum(r.raw_sum for r in rollup) == 4
    assert store.read("bridge").count() == 3      # (2016, digivol), (2019, digivol), (2019, les-herbonautes)
    # Re-importing the same tree changes nothing.
    jobs.import_history(spark, base, store, now="2026-06-02 00:00:00")
    again = {r.source_guid: r for r in store.read("records").collect()}
    assert {k: v.work_unit for k, v in again.items()} == {k: v.work_unit for k, v in recs.items()}
    assert all(again[k].created_at == recs[k].created_at for k in recs)

    jobs.rebuild_rollups(store, include_archived=True)
    assert store.read("rollup").count() == 4
    report = jobs.backfill_slugs(store).first()
    assert (report.updated, report.skipped) == (0, 3)  # all right already


def test_cli_commands(spark, capsys):
    from campaign_metrics.__main__ import main

    base = tempfile.mkdtemp(prefix="cm-cli-")
    _write(base, "2018-fall/newdata/final-n4Items.csv", ["guid", "timestamp", "project"],
           [["n-1", "2018-10-01T10:00:00Z", "Bees"], ["n-2", "2018-10-01T10:30:00Z", "Bees"]])
    root = os.path.join(tempfile.mkdtemp(prefix="cm-cli-store-"), "store")
    main(["import-history", "--base", base, "--store", root])
    main(["aggregate", "--store", root, "--all"])
    main(["backfill-slugs", "--store", root])
    main(["health", "--store", root])
    out = capsys.readouterr().out
    assert "2018-fall" in out and "updated" in out
    store = Store(spark, root)
    (camp,) = store.read("campaigns").collect()
    assert (camp.year, camp.season, camp.slug) == (2018, "fall", "campaign-2018-fall")
    (bucket,) = store.read("rollup").collect()
    assert bucket.raw_sum == 2 and bucket.center == "Notes From Nature"


def test_a_directory_of_headers_only_has_a_campaign_a_note_and_statistics(spark):
    base = tempfile.mkdtemp(prefix="cm-headers-")
    _write(base, "2018/newdata/ddf.csv", ["guid", "timestamp", "project"], [["n-1", "2018-10-01T10:00:00Z", "Bees"]])
    _write(base, "2021/newdata/ddf.csv", ["guid", "timestamp", "project"], [])
    store = Store(spark, os.path.join(tempfile.mkdtemp(prefix="cm-headers-store-"), "store"))
    stats = {r.campaign_dir: r for r in jobs.import_history(spark, base, store, now="2026-06-01 00:00:00").collect()}
    assert tuple(stats["2021"])[1:5] == (1, 0, 0, 0) and "2021" in stats["2021"].note
    assert tuple(stats["2018"]) == ("2018", 1, 1, 1, 0, None)
    camps = {r.year: r for r in store.read("campaigns").collect()}
    assert set(camps) == {2018, 2021} and camps[2021].notes == stats["2021"].note
