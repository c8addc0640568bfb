"""Free slugs, persisted deletes, form rules, source defaults and the hour x center grid."""

from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from campaign_metrics.operators import charts, quality, reports, upsert
from campaign_metrics.operators.rollup import hourly_rollup
from campaign_metrics.plans import jobs
from campaign_metrics.schema import SOURCES
from campaign_metrics.sources.store import SCHEMAS, Store
from tests.conftest import ts

SLUGS = "event_id bigint, year int, season string, slug string"


def one_by_one(rows):
    """The campaigns renamed one after another in id order."""
    slugs = {e: s for e, _, _, s in rows}
    for e, year, season, _ in sorted(rows):
        if year is None or not (season or "").strip():
            continue
        base = f"campaign-{year}-{season}"
        others = {s for o, s in slugs.items() if o != e}
        new, k = base, 2
        while new in others:
            new, k = f"{base}-{k}", k + 1
        slugs[e] = new
    return slugs


@pytest.mark.parametrize("seed", range(6))
def test_free_slugs_equal_renaming_one_by_one(spark, seed):
    rng = random.Random(seed)
    bases = ["campaign-2026-spring", "campaign-2026-fall", "campaign-2027-spring"]
    rows = []
    for e in rng.sample(range(100), 25):
        slug = rng.choice([None, "other", *bases, *(f"{b}-{k}" for b in bases for k in (2, 3, 4, 7))])
        rows.append((e, rng.choice([2026, 2026, 2027, None]), rng.choice(["spring", "spring", "fall", None, " "]), slug))
    taken, unique = set(), []
    for e, y, s, slug in rows:  # stored slugs are unique
        unique.append((e, y, s, None if slug in taken else slug))
        taken.add(slug)
    out = reports.free_slugs(spark.createDataFrame(unique, SLUGS)).collect()
    want = one_by_one(unique)
    assert {r.event_id: r.slug if r.skipped else r.new_slug for r in out} == want


def _store(spark, make_records):
    store = Store(spark, tempfile.mkdtemp(prefix="cm-delete-") + "/store")
    recs = make_records([dict(event_id=e, source_id=s, guid=f"{e}-{s}-{d}", when=f"2026-03-0{d} 10:00:00") for e in (1, 2) for s in (1, 2) for d in (1, 2)]
                        + [dict(event_id=1, source_id=2, guid="alone", when="2026-03-07 10:00:00")])
    store.append("records", recs)
    store.rebuild_rollup()
    pair = spark.createDataFrame([(e, s) for e in (1, 2) for s in (1, 2)], "event_id bigint, source_id bigint")
    store.write("bridge", pair.withColumn("is_enabled", F.lit(True)))
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS["checkpoints"].fields}
    store.write("checkpoints", pair.select(*[F.col(c) if c in pair.columns else x for c, x in empty.items()]))
    store.write("sources", spark.createDataFrame([(s, f"s{s}", f"s{s}", None, "api_json", True, None, True, None) for s in (1, 2)], SOURCES))
    store.write("campaigns", spark.createDataFrame([(e,) for e in (1, 2)], "event_id bigint").select(
        "event_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS["campaigns"].fields if f.name != "event_id"]))
    return store


def _left(store):
    counts = {n: store.read(n).count() for n in SCHEMAS if n != "quarantine"}
    rollup = sorted(map(tuple, store.read("rollup").select("event_id", "bucket_hour_utc", "raw_sum").collect()))
    plain = sorted(map(tuple, hourly_rollup(store.read("records")).select("event_id", "bucket_hour_utc", "raw_sum").collect()))
    assert rollup == plain
    return counts


def test_persisted_delete(spark, make_records):
    store = _store(spark, make_records)
    impact = {(r.table, r.event_id): r.n for r in jobs.delete(store, campaigns=[2]).collect()}
    assert impact == {("records", 2): 4, ("rollup", 2): 2, ("checkpoints", 2): 2, ("bridge", 2): 2}
    assert _left(store) == {"records": 5, "rollup": 3, "campaigns": 1, "sources": 2, "bridge": 2, "checkpoints": 2}
    jobs.delete(store, sources=[2])
    assert _left(store) == {"records": 2, "rollup": 2, "campaigns": 1, "sources": 1, "bridge": 1, "checkpoints": 1}
    jobs.delete(store, campaigns=[2, 77], sources=[2])  # gone already, or never there
    assert _left(store)["records"] == 2


@pytest.mark.parametrize("dies_at", ["rollup", "records", "checkpoints", "sources"])
def test_a_delete_that_died_is_run_again(spark, make_records, monkeypatch, dies_at):
    store = _store(spark, make_records)
    write = Store.write

    def failing(self, name, df, touched_only=True):
        if name == dies_at:
            raise RuntimeError("lost")
        write(self, name, df, touched_only)

    with monkeypatch.context() as m:
        m.setattr(Store, "write", failing)
        with pytest.raises(RuntimeError):
            jobs.delete(store, campaigns=[2], sources=[2])
    jobs.delete(store, campaigns=[2], sources=[2])
    assert _left(store) == {"records": 2, "rollup": 2, "campaigns": 1, "sources": 1, "bridge": 1, "checkpoints": 1}


def test_form_rules(spark):
    camps = spark.createDataFrame(
        [(1, 2026, "spring", "a", None, ts("2026-03-01 00:00:00"), ts("2026-03-02 00:00:00")), (2, None, None, None, "x" * 256, None, None),
         (3, 1999, "autumn", "b" * 256, None, ts("2026-03-02 00:00:00"), ts("2026-03-01 00:00:00"))],
        "event_id bigint, year int, season string, slug string, display_alias string, starts_at timestamp_ntz, ends_at timestamp_ntz")
    sources = spark.createDataFrame([(1, "n", "s", "api_json", "https://x.org/a?b"), (2, None, " ", None, "nothing"), (3, "n", "s", "csv", "http://" + "x" * 500)],
                                    "source_id bigint, name string, slug string, adapter_type string, base_url string")
    found = {(r.table_name, r.row_key, r.rule, r.detail) for r in quality.form_rules(camps, sources).collect()}
    assert {f[3] for f in found if f[:2] == ("campaigns", "2")} == {
        "missing year", "missing season", "missing slug", "display alias longer than 255", "missing start", "missing end"}
    assert {f[2:] for f in found if f[:2] == ("campaigns", "3")} == {
        ("Q3", "start year differs from campaign year"), ("Q3", "end year differs from campaign year"), ("Q3", "end not after start"),
        ("Q4", "year outside 2000-2100"), ("Q4", "slug longer than 255"), ("Q5", "season not allowed")}
    assert {f[3] for f in found if f[:2] == ("sources", "2")} == {"missing name", "missing slug", "missing adapter type", "base url is no url"}
    assert {f[2:] for f in found if f[:2] == ("sources", "3")} == {("Q4", "base url longer than 500"), ("Q5", "adapter type not allowed")}
    assert not {f for f in found if f[1] == "1"}


def test_stored_source_details_win_over_defaults(spark):
    rows = [(1, "", "digivol", "", "", True, None, True, ""), (2, "Own", "doedat", "https://own", "http_json", True, "w", True, "mine")]
    out = {r.slug: r for r in upsert.fill_source_defaults(
        spark.createDataFrame(rows, SOURCES), upsert.legacy_source_defaults(spark, {"digivol": ("https://d", "default notes"), "doedat": ("https://e", "n")})).collect()}
    assert (out["digivol"].name, out["digivol"].base_url, out["digivol"].notes) == ("DigiVol", "https://d", "default notes")
    assert (out["doedat"].name, out["doedat"].base_url, out["doedat"].notes, out["doedat"].is_active) == ("Own", "https://own", "mine", True)
    assert out["les-herbonautes"].base_url.startswith("http://") and out["les-herbonautes"].source_id > 2


def test_hour_center_grid(spark):
    rows = [(1, "A", ts("2026-03-09 10:00:00"), 1.0), (1, "B", ts("2026-03-09 11:00:00"), 2.0), (2, "C", ts("2026-03-09 10:00:00"), 3.0)]
    grid = charts.center_hour_grid(spark.createDataFrame(rows, "event_id bigint, center string, bucket timestamp_ntz, cumulative_weighted double"))
    assert sorted(((r.event_id, r.bucket.hour, r.center, r.cumulative_weighted) for r in grid.collect()), key=str) == sorted(
        [(1, 10, "A", 1.0), (1, 10, "B", None), (1, 11, "A", None), (1, 11, "B", 2.0), (2, 10, "C", 3.0)], key=str)


def test_a_dimension_write_that_dies_leaves_the_version_before(spark, monkeypatch):
    store = Store(spark, tempfile.mkdtemp(prefix="cm-versions-") + "/store")
    pair = lambda n: spark.createDataFrame([(k, k, True) for k in range(n)], SCHEMAS["bridge"])
    assert store.read("bridge").count() == 0
    store.write("bridge", pair(2))
    store.write("bridge", store.read("bridge").unionByName(pair(1)))  # reads the version that it replaces
    assert store.read("bridge").count() == 3
    bad = pair(5).withColumn("is_enabled", F.raise_error(F.lit("lost")).cast("boolean"))
    with pytest.raises(Exception, match="lost"):
        store.write("bridge", bad)
    assert store.read("bridge").count() == 3
    for n in (4, 5):
        store.write("bridge", pair(n))
    assert store.read("bridge").count() == 5 and len(store._versions("bridge")) <= 2


def test_compaction_keeps_the_rows(spark, make_records):
    store = Store(spark, tempfile.mkdtemp(prefix="cm-compact-") + "/store")
    for k in range(5):
        store.append("records", make_records([dict(guid=f"{k}"), dict(guid=f"{k}x", when="2026-03-12 10:00:00") if k == 0 else dict(guid=f"{k}y")]))
    before = sorted(r.source_guid for r in store.read("records").collect())
    assert store.compact("records", max_files=3) == 1 and store.compact("records", max_files=3) == 0
    assert sorted(r.source_guid for r in store.read("records").collect()) == before and store.compact("rollup") == 0
