"""Registered queries: one per operator of the inventory.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables at
``sf_dir`` (through the bindings), typed by ``present``. The matching DuckDB
SQL lives in ``plans.oracle`` under the same key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campaign_metrics.functions.json_paths import variant_first
from campaign_metrics.functions.text import canonical_slug
from campaign_metrics.functions.time import chart_time
from campaign_metrics.operators import adapters, audit, charts, importer, pages, quality, reports, upsert
from campaign_metrics.operators.rollup import hourly_rollup, rollup_or_raw
from campaign_metrics.operators.running import running_positions
from campaign_metrics.plans.present import present
from campaign_metrics.session import scratch_path
from campaign_metrics.sources import sinks
from campaign_metrics.sources.bindings import Tables, extra_directories, faulty_landing, tokened_pages, write_history_tree
from campaign_metrics.sources.feeds import explode_items, read_feed_pages, write_feed_pages
from campaign_metrics.sources.store import SCHEMAS, Store
from campaign_metrics.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(Tables(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return register


# --- 2.5 rollup ------------------------------------------------------------

@query("a1_hourly_rollup")
def a1(t: Tables) -> DataFrame:
    """A1: (campaign, hour, center) sums over all records."""
    return hourly_rollup(t.records)


@query("a1_hourly_rollup_large")
def a1_large(t: Tables) -> DataFrame:
    """A1 on the lineitem-derived records (bench scale)."""
    return hourly_rollup(t.records_large)


@query("a12_rollup_or_raw")
def a12(t: Tables) -> DataFrame:
    """Stored rollup rows plus A1 over records of campaigns lacking them."""
    return rollup_or_raw(t.rollup, t.records, t.campaigns)


# --- 2.5 / 2.6 chart series ---------------------------------------------------

@query("a2_activity_per_bucket")
def a2(t: Tables) -> DataFrame:
    return charts.activity_per_bucket(t.records, t.rollup, t.campaigns, t.now)


@query("a3_activity_by_center")
def a3(t: Tables) -> DataFrame:
    return charts.activity_by_center(t.records, t.rollup, t.campaigns, t.now)


@query("a4_campaign_summary")
def a4(t: Tables) -> DataFrame:
    return charts.campaign_summary(t.records, t.campaigns)


@query("w1_record_running_total")
def w1(t: Tables) -> DataFrame:
    return charts.record_running_totals(t.records, t.campaigns)


@query("w1_record_running_total_large")
def w1_large(t: Tables) -> DataFrame:
    """W1 over the lineitem-derived records: every campaign is large here."""
    camp = t.campaigns.withColumn("is_public", F.lit(True)).withColumn("is_live", F.lit(False))
    return charts.record_running_totals(t.records_large, camp)


@query("w2_center_running_total")
def w2(t: Tables) -> DataFrame:
    return charts.center_running_totals(charts.activity_by_center(t.records, t.rollup, t.campaigns, t.now))


@query("w3_series_running_total")
def w3(t: Tables) -> DataFrame:
    return charts.series_running_total(charts.activity_per_bucket(t.records, t.rollup, t.campaigns, t.now))


@query("w4_single_point_padding")
def w4(t: Tables) -> DataFrame:
    """W4 on the per-center series of every public campaign (zero cumulatives)."""
    series = charts.center_running_totals(charts.activity_by_center(t.records, t.rollup, t.campaigns, t.now))
    return charts.pad_single_points(series, ["event_id", "center"],
                                    ["weighted", "raw", "cumulative_weighted", "cumulative_raw"])


@query("w4_padded_series")
def w4p(t: Tables) -> DataFrame:
    """W4 over series of eight consecutive records each, spread over the campaigns: many have one point, and are padded."""
    recs = t.records.withColumn("center", F.floor(F.col("source_guid").cast("long") / 8).cast("string"))
    points = hourly_rollup(recs).select("event_id", "center", F.col("bucket_hour_utc").alias("bucket"),
                                        F.col("weighted_sum").alias("weighted"), F.col("raw_sum").alias("raw"))
    return charts.pad_single_points(charts.center_running_totals(points), ["event_id", "center"],
                                    ["weighted", "raw", "cumulative_weighted", "cumulative_raw"])


@query("w5_center_hour_matrix")
def w5(t: Tables) -> DataFrame:
    series = charts.center_running_totals(charts.activity_by_center(t.records, t.rollup, t.campaigns, t.now))
    padded = charts.pad_single_points(series, ["event_id", "center"],
                                      ["weighted", "raw", "cumulative_weighted", "cumulative_raw"])
    return charts.center_hour_matrix(padded)


@query("w5_center_hour_grid")
def w5g(t: Tables) -> DataFrame:
    """W5 (long form): every hour and center of a campaign, null where the center has no point."""
    by_center = charts.activity_by_center(t.records, t.rollup, t.campaigns, t.now)
    return charts.center_hour_grid(charts.center_running_totals(by_center))


@query("w8_adaptive_bucket")
def w8(t: Tables) -> DataFrame:
    """W8/W9/S4 meta: bucket size and time axis per public campaign."""
    return charts.chart_meta(t.campaigns, t.now)


@query("t1_series_order")
def t1(t: Tables) -> DataFrame:
    """Per-center series ordered by center then bucket, position made explicit."""
    s = charts.activity_by_center(t.records, t.rollup, t.campaigns, t.now)
    return running_positions(s, "event_id", ["center", "bucket"])


@query("t1_record_order_large")
def t1_large(t: Tables) -> DataFrame:
    """T1 on the lineitem-derived records: each record's number in its campaign, by center, time and key."""
    r = t.records_large.select("event_id", "center", "timestamp_utc", "dedupe_key")
    return running_positions(r, "event_id", ["center", "timestamp_utc", "dedupe_key"])


@query("u1_distinct_hours")
def u1(t: Tables) -> DataFrame:
    """The distinct union of bucket hours over centers, per campaign."""
    return charts.activity_by_center(t.records, t.rollup, t.campaigns, t.now).select("event_id", "bucket").distinct()


# --- 2.1 / 2.2 / 2.3 feeds ---------------------------------------------------


RECORD_COLS = ["event_id", "source_id", "source_guid", "center", "project", "description",
               "timestamp_utc", "work_unit", "raw_count", "dedupe_key"]


def _feed_records(t: Tables) -> DataFrame:
    return adapters.normalize_pages(t.feed_pages, t.sources).select(*RECORD_COLS)


def _feed_records_of(t: Tables, *types: str) -> DataFrame:
    return adapters.normalize_pages(t.feed_pages, t.sources, types=types).select(*RECORD_COLS)


@query("s1_feed_items")
def s1(t: Tables) -> DataFrame:
    """Object items of every landed page with their position and id."""
    pages = t.feed_pages.join(adapters.source_columns(t.sources), "source_id", "left")
    items = explode_items(pages)
    v = F.col("_v")
    return items.select("event_id", "source_id", "page_offset", F.col("item_pos").cast("long").alias("item_pos"),
                        variant_first(v, ("id", "guid")).alias("item_id"))


@query("n6_feed_records")
def n6(t: Tables) -> DataFrame:
    """Every adapter type dispatched from one scan of the landed pages."""
    return _feed_records(t)


@query("n3_generic_records")
def n3(t: Tables) -> DataFrame:
    return _feed_records_of(t, "api_json", "http_json")


@query("n4_biospex_records")
def n4(t: Tables) -> DataFrame:
    return _feed_records_of(t, "biospex_json")


@query("n5_digivol_records")
def n5(t: Tables) -> DataFrame:
    return _feed_records_of(t, "digivol_json")


@query("n1_path_coalesce")
def n1(t: Tables) -> DataFrame:
    """Generic items take the first non-null of timestamp_utc, timestamp."""
    return _feed_records_of(t, "api_json", "http_json").select("source_guid", "timestamp_utc")


@query("n2_weight_path")
def n2(t: Tables) -> DataFrame:
    """Weights of items whose source sets weight_field (read from that path only)."""
    ids = t.sources.filter(F.col("weight_field").isNotNull()).select("source_id")
    return _feed_records(t).join(F.broadcast(ids), "source_id", "left_semi").select(
        "source_id", "source_guid", "work_unit")


@query("n7_timestamp_utc")
def n7(t: Tables) -> DataFrame:
    """ISO text with 'Z' or an offset -> UTC wall time, for every kept item."""
    return _feed_records(t).select("source_id", "source_guid", "timestamp_utc")


@query("n8_dedupe_key")
def n8(t: Tables) -> DataFrame:
    return _feed_records(t).select("source_guid", "dedupe_key")


@query("n9_canonical_bounds")
def n9(t: Tables) -> DataFrame:
    """raw_count raised to at least 1, work_unit at 4 places."""
    return _feed_records(t).select("source_guid", "work_unit", "raw_count")


@query("f1_feed_rejects")
def f1(t: Tables) -> DataFrame:
    """items failing their adapter's required fields, and unreadable pages, with the reason."""
    pages = t.feed_pages.join(adapters.source_columns(t.sources), "source_id", "left")
    rej = adapters.reject_items(explode_items(pages)).unionByName(adapters.reject_pages(pages))
    v = F.try_parse_json("item")
    return rej.select("event_id", "source_id", "page_offset", "reason",
                      variant_first(v, ("id", "guid")).alias("item_id"))


def _landed_with_faults(t: Tables) -> str:
    """The landed pages written as lines of text, many with a fault; the folder."""
    def build():
        path = scratch_path(t.spark, "faulty-landing")
        faulty_landing(t.feed_pages).drop("page_offset").write.partitionBy("event_id").text(path)
        return path
    return t.materialized("faulty_landing", build)


def _judged(t: Tables) -> DataFrame:
    return pages.judge_pages(read_feed_pages(t.spark, _landed_with_faults(t)), t.sources)


@query("s1_quarantined_pages")
def s1q(t: Tables) -> DataFrame:
    """Landed pages that cannot be ingested, with the reason; of broken lines, what was landed."""
    q = pages.quarantined_pages(_judged(t))
    return q.select("event_id", "source_id", "page_offset", "fetched_at", "reason",
                    F.when(F.col("reason") == "broken line", F.col("text")).alias("text"))


@query("n6_good_page_records")
def n6g(t: Tables) -> DataFrame:
    """The records of the pages that are not quarantined, whole pages only."""
    return pages.good_records(_judged(t)).select(*RECORD_COLS)


@query("r1_page_states")
def r1s(t: Tables) -> DataFrame:
    """What the landed pages leave per pair: empty pages, failed pairs and mixed ones."""
    return pages.page_states(_judged(t))


# --- 2.9 upserts ---------------------------------------------------------------


def _upserted(t: Tables) -> DataFrame:
    return upsert.upsert_records(t.records, t.replay)


@query("w7_keep_last")
def w7(t: Tables) -> DataFrame:
    """A batch holding every record twice for k % 4 = 0; the later copy wins."""
    batch = t.records.select(*upsert.RECORD_COLUMNS).unionByName(t.replay.select(*upsert.RECORD_COLUMNS))
    return upsert.keep_last(batch).select("dedupe_key", "work_unit", F.col("ingest_seq.pos").alias("ingest_seq"))


@query("m1_record_upsert")
def m1(t: Tables) -> DataFrame:
    return _upserted(t).select("dedupe_key", "event_id", "center", "work_unit", "raw_count", "created_at",
                               F.col("ingest_seq.pos").alias("ingest_seq"))


@query("m2_rollup_upsert")
def m2(t: Tables) -> DataFrame:
    """M2: stored rollup with the replayed campaigns rebuilt from the upserted records."""
    return upsert.rebuild_rollup(t.rollup, _upserted(t), upsert.touched_campaigns(t.replay))


def _batch_stats(t: Tables) -> DataFrame:
    """Per pair of the replay batch: latest record time; sources with
    id % 7 = 0 fail with a long message (cut to 2000 chars by M3)."""
    stats = t.replay.groupBy("event_id", "source_id").agg(F.max("timestamp_utc").alias("max_ts"))
    err = F.when(F.col("source_id") % 7 == 0, F.concat(F.lit("feed failed: "), F.repeat(F.lit("x"), 2100)))
    return stats.select("event_id", "source_id", F.when(err.isNull(), F.col("max_ts")).alias("max_ts"),
                        F.lit(None).cast("string").alias("next_page_token"), err.alias("error"))


@query("m3_checkpoint_upsert")
def m3(t: Tables) -> DataFrame:
    return upsert.advance_checkpoints(t.checkpoints, _batch_stats(t), t.now)


@query("a11_cursor_advance")
def a11(t: Tables) -> DataFrame:
    return reports.cursor_advance(t.checkpoints, t.replay)


def _dir_campaigns(t: Tables) -> DataFrame:
    dirs = t.directories.unionByName(extra_directories(t.raw("region")))
    return reports.directory_campaigns(dirs, t.now)


@query("m4_campaign_upsert")
def m4(t: Tables) -> DataFrame:
    return upsert.upsert_campaigns(t.campaigns, _dir_campaigns(t))


@query("m5_source_defaults")
def m5(t: Tables) -> DataFrame:
    return upsert.fill_source_defaults(t.sources, upsert.legacy_source_defaults(t.spark)).select(
        "source_id", "slug", "name", "adapter_type", "supports_weighting", "is_active", "weight_field")


@query("m5_stored_sources")
def m5s(t: Tables) -> DataFrame:
    """M5 over stored legacy sources: each of them with some fields of its own and some empty, and one that is not stored."""
    v = F.col("source_id")
    legacy = upsert.legacy_source_defaults(t.spark).withColumn("_n", F.ascii("slug"))
    stored = legacy.filter("slug <> 'doedat'").select(
        (F.col("_n") + F.length("slug") * 200).cast("long").alias("source_id"), F.concat(F.lit("Own "), "name").alias("name"), "slug",
        F.lit("https://example.org/own").alias("base_url"), "adapter_type", "supports_weighting", "weight_field",
        F.lit(False).alias("is_active"), F.lit("own notes").alias("notes"))
    stored = stored.select(
        v, F.when(v % 2 == 0, "").otherwise(F.col("name")).alias("name"), "slug", F.when(v % 3 == 0, F.col("base_url")).alias("base_url"),
        F.when(v % 5 == 0, "").otherwise(F.lit("http_json")).alias("adapter_type"), (~F.col("supports_weighting")).alias("supports_weighting"),
        F.when(v % 2 == 1, "").alias("weight_field"), "is_active", F.when(v % 2 == 0, "").otherwise(F.col("notes")).alias("notes"))
    own = {"citsciscribe": ("https://example.org/citsci", "passed by the deployment"), "smithsonian": (None, "notes only")}
    everything = t.sources.select(*stored.columns).unionByName(stored)
    return upsert.fill_source_defaults(everything, upsert.legacy_source_defaults(t.spark, own))


@query("m6_bridge_upsert")
def m6(t: Tables) -> DataFrame:
    """M6: pairs seen in the lineitem-derived records become enabled bridge rows."""
    return upsert.upsert_bridge(t.bridge, reports.sources_seen(t.records_large))


def _all_tables(t: Tables) -> dict[str, DataFrame]:
    return {"records": t.records, "rollup": t.rollup, "checkpoints": t.checkpoints, "bridge": t.bridge,
            "campaigns": t.campaigns, "sources": t.sources}


@query("j10_cascade_delete")
def j10(t: Tables) -> DataFrame:
    """Delete campaign 2 and source 7; rows left per table."""
    left = upsert.cascade_delete(_all_tables(t), t.campaigns.filter("event_id = 2").select("event_id"),
                                 t.sources.filter("source_id = 7").select("source_id"))
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name))
             for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- filters, joins, reports ---------------------------------------------------

@query("f2_active_now")
def f2(t: Tables) -> DataFrame:
    return reports.active_now(t.campaigns, t.now).select("event_id", "slug")


@query("f3_public_only")
def f3(t: Tables) -> DataFrame:
    return reports.public_only(t.campaigns).select("event_id", "slug")


@query("f4_not_archived")
def f4(t: Tables) -> DataFrame:
    return reports.not_archived(t.campaigns).select("event_id", "slug")


@query("f5_search_campaigns")
def f5(t: Tables) -> DataFrame:
    return reports.search_campaigns(t.campaigns, "ameri").select("event_id", "slug")


@query("f5_search_sources")
def f5s(t: Tables) -> DataFrame:
    return reports.search_sources(t.sources, "nation_1").select("source_id", "name")


@query("f6_flag_filters")
def f6(t: Tables) -> DataFrame:
    return reports.flag_filter(t.campaigns, is_public=True, is_live=False, is_archived=None).select("event_id")


@query("f6_source_flag_filters")
def f6s(t: Tables) -> DataFrame:
    return reports.flag_filter(t.sources, is_active=True, supports_weighting=None).select("source_id")


@query("f7_recent_activity")
def f7(t: Tables) -> DataFrame:
    return reports.recent_activity(t.campaigns, t.checkpoints, t.now).select("event_id")


@query("f7_quiet_campaigns")
def f7q(t: Tables) -> DataFrame:
    """F7 over checkpoints whose runs lie three minutes further back with every campaign: the later ones are quiet."""
    back = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") * 3).cast("int"), F.lit(0))
    return reports.recent_activity(t.campaigns, t.checkpoints.withColumn("last_run_at", t.now - back), t.now).select("event_id")


@query("j1_ingest_plan")
def j1(t: Tables) -> DataFrame:
    return reports.ingest_plan(t.campaigns, t.bridge, t.sources, t.now)


@query("j2_records_with_campaign")
def j2(t: Tables) -> DataFrame:
    return reports.records_with_campaign(t.records, t.campaigns).select("dedupe_key", "event_id", "year", "season")


@query("j3_campaign_child_counts")
def j3(t: Tables) -> DataFrame:
    return reports.campaign_child_counts(t.campaigns, t.records, t.bridge, t.rollup, t.checkpoints)


@query("j3_source_child_counts")
def j3s(t: Tables) -> DataFrame:
    return reports.source_child_counts(t.sources, t.bridge)


@query("j4_checkpoint_labels")
def j4(t: Tables) -> DataFrame:
    """J4 over checkpoints plus the replay's pairs for campaigns/sources that do not exist."""
    orphans = t.checkpoints.select("event_id", "source_id", "last_status").withColumn(
        "event_id", F.col("event_id") + 100)
    cps = t.checkpoints.select("event_id", "source_id", "last_status").unionByName(orphans)
    return reports.checkpoint_labels(cps, t.campaigns, t.sources)


@query("j5_campaigns_with_records")
def j5(t: Tables) -> DataFrame:
    return reports.campaigns_with_records(t.campaigns, t.records).select("event_id")


@query("j5_some_with_records")
def j5s(t: Tables) -> DataFrame:
    """J5 over stored campaigns and those that an import would add, which have no records."""
    return reports.campaigns_with_records(_campaigns_plus_dirs(t), t.records).select("event_id", "slug")


@query("j6_campaigns_without_rollup")
def j6(t: Tables) -> DataFrame:
    return reports.campaigns_without_rollup(t.campaigns, t.rollup).select("event_id")


@query("j7_fallback_records")
def j7(t: Tables) -> DataFrame:
    missing = reports.campaigns_without_rollup(t.campaigns, t.rollup)
    return reports.records_of(t.records, missing).select("dedupe_key", "event_id")


@query("j8_campaign_totals")
def j8(t: Tables) -> DataFrame:
    """Every campaign with its total raw count, missing -> 0."""
    totals = t.records_large.groupBy("event_id").agg(F.sum(F.col("raw_count").cast("long")).alias("total"))
    more = t.campaigns.select("event_id").unionByName(
        t.campaigns.select((F.col("event_id") + 5).alias("event_id")))
    return more.join(totals, "event_id", "left").select("event_id", F.coalesce("total", F.lit(0)).alias("total"))


@query("j9_source_names")
def j9(t: Tables) -> DataFrame:
    return reports.source_names_per_campaign(t.campaigns, t.bridge, t.sources)


@query("a5_transactions_per_campaign")
def a5(t: Tables) -> DataFrame:
    return reports.transactions_per_campaign(t.campaigns, t.rollup, t.records)


@query("a6_transactions_per_year")
def a6(t: Tables) -> DataFrame:
    return reports.transactions_per_year(t.records, t.campaigns)


@query("a7_admin_stats")
def a7(t: Tables) -> DataFrame:
    return reports.admin_stats(t.sources, t.campaigns, t.checkpoints)


@query("a8_observed_window")
def a8(t: Tables) -> DataFrame:
    """A8 over campaigns 0-5 (campaign 5 has no records and keeps its window)."""
    extra = t.campaigns.filter("event_id = 4").withColumn("event_id", F.lit(5).cast("long"))
    return reports.observed_window(t.campaigns.unionByName(extra), t.records)


@query("a9_sources_seen")
def a9(t: Tables) -> DataFrame:
    return reports.sources_seen(t.records_large)


@query("t2_list_campaigns")
def t2(t: Tables) -> DataFrame:
    return reports.list_campaigns(t.campaigns).select("event_id", "starts_at", "position")


@query("t2_list_sources")
def t2s(t: Tables) -> DataFrame:
    return reports.list_sources(t.sources).select("source_id", "name", "position")


@query("t3_season_order")
def t3(t: Tables) -> DataFrame:
    c = _dir_campaigns(t).withColumn("slug", canonical_slug(F.col("year"), F.col("season")))
    return c.select("year", "season", "slug", F.row_number().over(
        Window.orderBy("year", reports.season_rank(F.col("season")), "slug")).alias("position"))


@query("t4_latest_checkpoint")
def t4(t: Tables) -> DataFrame:
    return reports.latest_checkpoint(t.checkpoints).select("event_id", "source_id", "last_run_at", "last_status")


@query("t5_first_live_public")
def t5(t: Tables) -> DataFrame:
    return reports.first_live_public(t.campaigns).select("event_id", "slug")


@query("u2_union_by_name")
def u2(t: Tables) -> DataFrame:
    """Records and feed records (different column sets) concatenated by name."""
    a = t.records.select("event_id", "dedupe_key", "ingest_seq").withColumn("origin", F.lit("records"))
    b = _feed_records(t).select("event_id", "dedupe_key").withColumn("origin", F.lit("feeds"))
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy("origin", "event_id").agg(F.count(F.lit(1)).alias("n"),
                                               F.count("ingest_seq").alias("n_with_seq"))


@query("u3_id_difference")
def u3(t: Tables) -> DataFrame:
    return reports.campaign_id_difference(t.campaigns, t.rollup)


@query("n16_directory_attributes")
def n16(t: Tables) -> DataFrame:
    dirs = t.directories.unionByName(extra_directories(t.raw("region")))
    return reports.directory_attributes(dirs, t.now)


@query("n17_n19_campaign_labels")
def n17(t: Tables) -> DataFrame:
    """N17 canonical slug, N18 display name, N19 report label over stored and
    directory-derived campaigns (some without a season)."""
    dc = _dir_campaigns(t).withColumn("event_id", F.lit(None).cast("long"))
    cols = ["event_id", "year", "season", "display_alias"]
    c = t.campaigns.select(*cols).unionByName(dc.select(*cols))
    return reports.campaign_labels(c.withColumn("slug", F.lit(None))).select(
        F.col("event_id"), "canonical_slug", "display_name", "report_label")


@query("n20_zone_conversion")
def n20(t: Tables) -> DataFrame:
    return reports.zone_views(t.campaigns)


@query("n21_no_data_state")
def n21(t: Tables) -> DataFrame:
    """N21 for public campaigns without feed records from active sources."""
    active = t.sources.filter("is_active").select("source_id")
    recs = _feed_records(t).join(F.broadcast(active), "source_id", "left_semi").filter("event_id <> 0")
    return reports.no_data_state(t.campaigns, recs, t.now)


@query("w6_slug_suffix")
def w6(t: Tables) -> DataFrame:
    dc = _dir_campaigns(t)
    ids = dc.select((F.lit(1000) + F.dense_rank().over(
        Window.orderBy("year", F.col("season").asc_nulls_first())))
        .cast("long").alias("event_id"), "year", "season")
    c = t.campaigns.select("event_id", "year", "season", "slug").unionByName(
        ids.withColumn("slug", F.lit(None).cast("string")))
    return reports.slug_suffixes(c)


@query("w6_free_slugs")
def w6f(t: Tables) -> DataFrame:
    """Smallest free suffixes over campaigns of shared bases whose stored slugs occupy suffixes of their own and of
    other bases."""
    return reports.free_slugs(_crowded_campaigns(t))


def _crowded_campaigns(t: Tables) -> DataFrame:
    """Four campaigns from each stored one: itself, one that has a suffix already, one without season that holds a suffix,
    one of the next base that holds a suffix of this one."""
    c = t.campaigns.select("event_id", "year", "season", "slug")
    others = c.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3))))
    copies = others.select(
        (F.col("event_id") + 10 * F.col("copy")).alias("event_id"),
        F.when(F.col("copy") == 3, F.col("year") + 2).otherwise(F.col("year")).alias("year"),
        F.when(F.col("copy") != 2, F.col("season")).alias("season"),
        F.concat("slug", F.lit("-"), (5 - F.col("copy")).cast("string")).alias("slug"))
    return c.unionByName(copies)


@query("w6_slug_backfill_report")
def w6r(t: Tables) -> DataFrame:
    c = t.campaigns.select("event_id", "year", "season", "slug").unionByName(
        t.campaigns.select((F.col("event_id") + 10).alias("event_id"), "year",
                           F.when(F.col("event_id") == 2, F.lit(None)).otherwise(F.col("season")).alias("season"),
                           F.lit(None).cast("string").alias("slug")))
    return reports.slug_backfill_report(reports.slug_suffixes(c))


@query("r6_health_report")
def r6(t: Tables) -> DataFrame:
    return reports.health_report(t.checkpoints, t.campaigns, t.sources)


# --- 2.12 quality audits, 2.11 feed audit ----------------------------------------


CAMPAIGN_COLS = ["event_id", "slug", "year", "season", "starts_at", "ends_at", "is_public", "is_live",
                 "is_archived", "display_alias", "notes"]


def _campaigns_plus_dirs(t: Tables) -> DataFrame:
    """Stored campaigns plus the ones a historical import would add (ids from 1001)."""
    dc = _dir_campaigns(t)
    dc = dc.withColumn("event_id", (F.lit(1000) + F.dense_rank().over(
        Window.orderBy("year", F.col("season").asc_nulls_first()))).cast("long"))
    dc = dc.withColumn("slug", canonical_slug(F.col("year"), F.col("season")))
    return t.campaigns.select(*CAMPAIGN_COLS).unionByName(dc.select(*CAMPAIGN_COLS))


@query("q1_unique_keys")
def q1(t: Tables) -> DataFrame:
    bridge = t.bridge.select("event_id", "source_id").unionByName(reports.sources_seen(t.records_large))
    records = t.records.select("dedupe_key").unionByName(t.replay.select("dedupe_key"))
    return quality.unique_keys(_campaigns_plus_dirs(t), bridge, records)


@query("q2_single_live")
def q2(t: Tables) -> DataFrame:
    """Q2 after a second campaign (id 3) is switched live."""
    c = t.campaigns.withColumn("is_live", F.col("is_live") | (F.col("event_id") == 3))
    return quality.single_live(c)


@query("q3_window_consistency")
def q3(t: Tables) -> DataFrame:
    return quality.window_consistency(_campaigns_plus_dirs(t))


@query("q4_required_and_ranges")
def q4(t: Tables) -> DataFrame:
    return quality.required_and_ranges(_campaigns_plus_dirs(t), t.sources)


@query("q5_allowed_values")
def q5(t: Tables) -> DataFrame:
    return quality.allowed_values(_campaigns_plus_dirs(t), t.sources)


def _spoilt_campaigns(t: Tables) -> DataFrame:
    """Every stored campaign as it is, and once for each rule of its form, with that rule broken."""
    v, c = F.col("copy"), t.campaigns.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(12))))
    text = lambda n: F.repeat(F.lit("x"), F.lit(n))
    return c.select(
        (v * 100 + F.col("event_id")).alias("event_id"),
        F.when(v == 1, 1999).when(v == 2, None).otherwise(F.col("year")).alias("year"),
        F.when(v == 3, "").when(v == 4, "winter").otherwise(F.col("season")).alias("season"),
        F.when(v == 5, None).when(v == 6, text(256)).when(v == 12, " ").otherwise(F.col("slug")).alias("slug"),
        F.when(v == 7, text(300)).otherwise(F.col("display_alias")).alias("display_alias"),
        F.when(v != 8, F.col("starts_at")).alias("starts_at"),
        F.when(v == 9, None).when(v == 10, F.col("starts_at")).when(v == 11, F.col("ends_at") + F.make_dt_interval(F.lit(366)))
         .otherwise(F.col("ends_at")).alias("ends_at"))


def _spoilt_sources(t: Tables) -> DataFrame:
    v, s = F.col("copy"), t.sources.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9))))
    text = lambda n: F.repeat(F.lit("x"), F.lit(n))
    return s.select(
        (v * 100 + F.col("source_id")).alias("source_id"),
        F.when(v == 1, "  ").when(v == 2, text(256)).otherwise(F.col("name")).alias("name"),
        F.when(v == 3, None).when(v == 4, text(256)).otherwise(F.col("slug")).alias("slug"),
        F.when(v == 5, None).when(v == 6, "ftp_csv").otherwise(F.col("adapter_type")).alias("adapter_type"),
        F.when(v == 7, "not a url").when(v == 8, F.concat(F.lit("https://"), text(500))).when(v == 9, "https://example.org/feed?x=1")
         .otherwise(F.col("base_url")).alias("base_url"))


@query("q345_form_rules")
def q345(t: Tables) -> DataFrame:
    """Q3-Q5: every form rule in one scan a table, over rows that break each of them."""
    return quality.form_rules(_spoilt_campaigns(t), _spoilt_sources(t))


@query("q6_record_bounds")
def q6(t: Tables) -> DataFrame:
    """Q6 on unconverted candidate values derived from events (value x 5000, k x 3)."""
    k = F.get_json_object("payload_json", "$.k").try_cast("int")
    cand = t.records.select("dedupe_key",
                            (F.col("work_unit").cast("double") * 50000).alias("work_unit_value"),
                            (k * 3).cast("long").alias("raw_count_value"))
    return quality.record_bounds(cand)


@query("q7_referential_integrity")
def q7(t: Tables) -> DataFrame:
    orphans = t.checkpoints.select((F.col("event_id") + 100).alias("event_id"),
                                   (F.col("source_id") + 100).alias("source_id"))
    children = {"records": t.records_large.select("event_id", "source_id"),
                "checkpoints": t.checkpoints.select("event_id", "source_id").unionByName(orphans),
                "bridge": t.bridge.select("event_id", "source_id"),
                "rollup": t.rollup.select("event_id")}
    return quality.referential_integrity(children, t.campaigns, t.sources)


@query("r5_missing_next_pages")
def r5(t: Tables) -> DataFrame:
    """R5 over the landed pages minus every page with offset % 7 = 3 (not landed)."""
    landed = t.feed_pages.filter(F.col("page_offset") % 7 != 3)
    return audit.missing_next_pages(landed, t.sources)


@query("r5_token_walk")
def r5w(t: Tables) -> DataFrame:
    """R5 by following tokens, opaque and numeric, over a landing where one page in 29 is missing."""
    return audit.walk_pages(tokened_pages(t.feed_pages), t.sources)


# --- 2.1 S2 / 2.2 N10-N15 / A10: historical CSV import ------------------------------


def _history(t: Tables):
    """Write the events-derived CSV tree once per Tables, then import it:
    campaigns from the directories (N16 + M4), legacy sources (M5), records."""
    def build():
        base = write_history_tree(t.raw("events"), scratch_path(t.spark, "history"))
        rows = importer.read_history_rows(t.spark, base)
        dirs = importer.history_files(t.spark, base).select(F.col("campaign_dir").alias("directory")).distinct()
        camps = upsert.upsert_campaigns(t.campaigns, reports.directory_campaigns(dirs, t.now))
        by_dir = reports.directory_attributes(dirs, t.now).alias("d").join(
            camps.alias("c"), (F.col("d.year") == F.col("c.year")) & F.col("d.season").eqNullSafe(F.col("c.season")))
        by_dir = by_dir.select(F.col("d.directory").alias("campaign_dir"), "c.event_id", "c.display_alias", "c.slug",
                               "c.year", "c.season")
        srcs = upsert.fill_source_defaults(t.sources, upsert.legacy_source_defaults(t.spark))
        recs = importer.history_records(rows, by_dir, srcs)
        return base, rows, recs
    return t.materialized("history", build)


@query("s2_csv_files")
def s2(t: Tables) -> DataFrame:
    """Discovered importable files per campaign directory (newdata rule, name filter)."""
    base, _, _ = _history(t)
    return importer.history_files(t.spark, base)


@query("n13_csv_records")
def n13(t: Tables) -> DataFrame:
    return _history(t)[2].select(*RECORD_COLS)


@query("n10_csv_header_forms")
def n10(t: Tables) -> DataFrame:
    """Ddf rows resolve guid through guid, then 'id' (the later of ID/id)."""
    return _history(t)[2].filter(F.col("file_name") == "ddf.csv").select("source_guid", "description")


@query("n10_csv_file_forms")
def n10a(t: Tables) -> DataFrame:
    """Guid and description of the rows of every file, whatever its header's forms."""
    return _history(t)[2].select("file_name", "source_guid", "description")


@query("n11_csv_filled")
def n11(t: Tables) -> DataFrame:
    """Blank and NA cells are missing (project NULL)."""
    return _history(t)[2].select("source_guid", "project")


@query("n12_csv_numeric")
def n12(t: Tables) -> DataFrame:
    """Non-numeric first weight (NaN, 5d) and blank -> 1.0."""
    return _history(t)[2].select("source_guid", "work_unit", "raw_count")


@query("n14_csv_source")
def n14(t: Tables) -> DataFrame:
    return _history(t)[2].select("source_guid", "source_id")


@query("n15_csv_center")
def n15(t: Tables) -> DataFrame:
    return _history(t)[2].select("source_guid", "center")


@query("a10_import_stats")
def a10(t: Tables) -> DataFrame:
    base, rows, recs = _history(t)
    return importer.import_stats(rows, recs, importer.history_files(t.spark, base))


# --- 2.1 S4/S5 sinks ---------------------------------------------------------------


def _center_series(t: Tables) -> DataFrame:
    return charts.center_running_totals(charts.activity_by_center(t.records, t.rollup, t.campaigns, t.now))


@query("s4_chart_series")
def s4(t: Tables) -> DataFrame:
    """S4 flat: chart metadata next to every by-center point (ISO hour text)."""
    return sinks.center_series_flat(charts.chart_meta(t.campaigns, t.now), _center_series(t))


@query("s4_chart_documents")
def s4d(t: Tables) -> DataFrame:
    """S4 nested: one chart document per public campaign (rows-only check)."""
    return sinks.center_documents(charts.chart_meta(t.campaigns, t.now), _center_series(t))


@query("s4_document_points")
def s4p(t: Tables) -> DataFrame:
    """The points inside the chart documents, read back from their parts of at most 40 points."""
    parts = sinks.center_document_parts(_center_series(t), points=40)
    p = parts.select("event_id", "center", "part", F.posexplode("points").alias("place", "p"))
    return p.select("event_id", "center", F.col("part"), F.col("place").cast("long").alias("place"), "p.hour", "p.weighted",
                    "p.cumulative_weighted", "p.raw", "p.cumulative_raw")


@query("s5_snapshot_points")
def s5p(t: Tables) -> DataFrame:
    """The points inside the refreshed snapshots, read back from the JSON of their parts of at most 40 points."""
    per_bucket = charts.activity_per_bucket(t.records, t.rollup, t.campaigns, t.now)
    parts = sinks.snapshot_parts(t.campaigns, {"hourly": per_bucket, "by_center": _center_series(t)}, t.now, points=40)
    schema = "array<struct<bucket: timestamp_ntz, center: string, weighted: double, raw: bigint>>"
    rows = parts.select("event_id", "snapshot_type", "part", F.inline(F.from_json("data_json", schema)))
    return rows.select("event_id", "snapshot_type", "part", "bucket", "center", "weighted", "raw")


@query("s5_snapshots")
def s5(t: Tables) -> DataFrame:
    """Prior snapshots (campaign 0 fresh, 1 stale, 4 live) refreshed at now."""
    age = {0: 600, 1: 1200, 4: 60}
    prior = t.campaigns.filter(F.col("event_id").isin(*age)).select(
        "event_id", F.lit("hourly").alias("snapshot_type"), F.lit("[]").alias("data_json"),
        (t.now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                    F.element_at(F.create_map(*[F.lit(x) for kv in age.items() for x in kv]),
                                                 F.col("event_id").cast("int")))).alias("generated_at"))
    per_bucket = charts.activity_per_bucket(t.records, t.rollup, t.campaigns, t.now)
    chart_rows = {"hourly": per_bucket, "by_center": _center_series(t)}
    return sinks.materialize_snapshots(prior, t.campaigns, chart_rows, t.now).select(
        "event_id", "snapshot_type", "generated_at", "points")


# --- 2.11 streaming ------------------------------------------------------------------


def _stream_run(t: Tables, name: str, landings: list) -> Store:
    """Land the derived pages in several drops; after each drop a scheduled
    ``availableNow`` run of the ingest stream drains it."""
    def build():
        root = scratch_path(t.spark, name)
        landing, store = f"{root}/landing", Store(t.spark, f"{root}/store")
        pages = t.feed_pages
        for cond in landings:
            write_feed_pages(pages.filter(cond), landing)
            q = ingest.start_ingest(t.spark, landing, store, t.sources, f"{root}/_stream", now=t.now)
            q.awaitTermination()
        return store
    return t.materialized(("stream", name), build)


def _thirds():
    return [F.col("page_offset") % 3 == i for i in range(3)]


@query("r1_stream_ingest")
def r1(t: Tables) -> DataFrame:
    """Records after three scheduled runs of the ingest stream."""
    return _stream_run(t, "r1", _thirds()).read("records").select(*RECORD_COLS)


@query("r1_stream_checkpoints")
def r1c(t: Tables) -> DataFrame:
    cp = _stream_run(t, "r1", _thirds()).read("checkpoints")
    return cp.select("event_id", "source_id", "last_seen_timestamp", "last_status", "last_run_at")


@query("r1_faulty_checkpoints")
def r1f(t: Tables) -> DataFrame:
    """Checkpoints after two scheduled runs over a landing with faulty, empty and unknown pages."""
    def build():
        root = scratch_path(t.spark, "r1-faulty")
        landing, store = f"{root}/landing", Store(t.spark, f"{root}/store")
        for half in range(2):
            drop = faulty_landing(t.feed_pages).filter((F.col("page_offset") >= 50) == F.lit(half == 1)).drop("page_offset")
            drop.write.mode("append").partitionBy("event_id").text(landing)
            ingest.start_ingest(t.spark, landing, store, t.sources, f"{root}/_stream", now=t.now).awaitTermination()
        return store
    return t.materialized(("stream", "r1-faulty"), build).read("checkpoints")


@query("r1_stream_quarantine")
def r1q(t: Tables) -> DataFrame:
    """How many pages of each reason the two runs quarantined."""
    r1f(t)
    store = t.materialized(("stream", "r1-faulty"), lambda: None)
    return store.read("quarantine").groupBy("reason").agg(F.count(F.lit(1)).alias("pages"))


@query("r3_replay_idempotent")
def r3(t: Tables) -> DataFrame:
    """Every page landed twice (second drop replays the first)."""
    store = _stream_run(t, "r3", [F.lit(True), F.lit(True)])
    return store.read("records").select("dedupe_key", "work_unit", "raw_count", "created_at")


@query("r4_late_data_rollup")
def r4(t: Tables) -> DataFrame:
    """Later pages land first, earlier (late) ones after; the rollup still
    equals A1 over everything."""
    store = _stream_run(t, "r4", [F.col("page_offset") >= 50, F.col("page_offset") < 50])
    return store.read("rollup")


@query("r2_tumbling_windows")
def r2(t: Tables) -> DataFrame:
    """R2: streaming hour windows per campaign and center (complete mode)."""
    def build():
        root = scratch_path(t.spark, "r2")
        write_feed_pages(t.feed_pages, f"{root}/landing")
        q = ingest.start_windowed(t.spark, f"{root}/landing", t.sources, f"{root}/out", f"{root}/_stream")
        q.awaitTermination()
        return t.spark.read.parquet(f"{root}/out")
    return t.materialized(("stream", "r2"), build)


def _window_changes(t: Tables) -> str:
    """Two drops into one stream: the pages below 60, then all pages, so that most land twice; the folder written."""
    def build():
        root = scratch_path(t.spark, "r2-changes")
        for drop in (t.feed_pages.filter("page_offset < 60"), t.feed_pages):
            write_feed_pages(drop, f"{root}/landing")
            ingest.start_window_changes(t.spark, f"{root}/landing", t.sources, f"{root}/out", f"{root}/_stream").awaitTermination()
        return f"{root}/out"
    return t.materialized(("stream", "r2-changes"), build)


@query("r2_deduplicated_windows")
def r2d(t: Tables) -> DataFrame:
    """R2: windows over records that landed twice are those of records that landed once."""
    return ingest.read_windows(t.spark, _window_changes(t))


@query("r2_changed_windows")
def r2c(t: Tables) -> DataFrame:
    """R2: how many windows each drop wrote: the second one only those with new records."""
    written = t.spark.read.parquet(_window_changes(t))
    return written.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("windows"))


# --- remaining inventory rows ------------------------------------------------------------


@query("s3_store_roundtrip")
def s3(t: Tables) -> DataFrame:
    """S3: records written partitioned by campaign, then read back for two
    campaigns (partition pruning on event_id)."""
    def build():
        store = Store(t.spark, scratch_path(t.spark, "s3"))
        store.write("records", t.records.select(*upsert.RECORD_COLUMNS))
        return store
    store = t.materialized(("store", "s3"), build)
    return store.read("records").filter(F.col("event_id").isin(1, 3)).select(
        "dedupe_key", "event_id", "center", "timestamp_utc", "work_unit", "raw_count")


@query("s3_whole_store")
def s3w(t: Tables) -> DataFrame:
    """S3: the written records of every campaign, read back."""
    s3(t)
    store = t.materialized(("store", "s3"), lambda: None)
    return store.read("records").select("dedupe_key", "event_id", "center", "timestamp_utc", "work_unit", "raw_count")


@query("w9_time_axis")
def w9(t: Tables) -> DataFrame:
    """Chart time per record: first-ingest time for live campaigns, activity time otherwise."""
    dims = F.broadcast(t.campaigns.select("event_id", "is_live"))
    return t.records.join(dims, "event_id").select("dedupe_key", chart_time(F.col("is_live")).alias("chart_ts"))


@query("n18_display_name")
def n18(t: Tables) -> DataFrame:
    return n17(t).select("event_id", "display_name")


@query("n19_report_label")
def n19(t: Tables) -> DataFrame:
    return n17(t).select("event_id", "report_label")


@query("j10_persisted_delete")
def j10p(t: Tables) -> DataFrame:
    """Campaign 2 and source 7 deleted from a written store, twice; rows left per table."""
    def build():
        store = Store(t.spark, scratch_path(t.spark, "j10"))
        for name, df in _all_tables(t).items():
            if name != "rollup":
                store.write(name, df.select(*[f.name for f in SCHEMAS[name].fields]))
        store.rebuild_rollup()
        for _ in range(2):
            store.delete(t.campaigns.filter("event_id = 2"), t.sources.filter("source_id = 7"))
        return store
    store = t.materialized(("store", "j10"), build)
    counts = [store.read(name).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name)) for name in SCHEMAS
              if name != "quarantine"]
    return reduce(DataFrame.unionByName, counts)


@query("j10_delete_impact")
def j10i(t: Tables) -> DataFrame:
    """Rows a deletion of campaign 2 would remove, per child table."""
    ids = t.campaigns.filter("event_id = 2").select("event_id")
    return upsert.delete_impact(_all_tables(t), ids).select("table", "event_id", "n")


@query("t5_embed_target")
def t5e(t: Tables) -> DataFrame:
    """The embedded chart's campaign and its data flag."""
    return reports.embed_target(t.campaigns, t.records)


@query("t2_public_index")
def t2p(t: Tables) -> DataFrame:
    """The public campaign index with record counts, newest first."""
    return reports.public_index(t.campaigns, t.records)
