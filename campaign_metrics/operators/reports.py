"""Planning, admin reports, listings and labels (F2-F7, J1-J9, A5-A9, A11,
T2-T5, U2, U3, N16-N21, W6).

Dimensions (campaigns, sources, the bridge, checkpoints) are small; the
records side is aggregated before it meets them, so every join with a fact
table is a broadcast of a bounded dimension or a join of pre-aggregated counts.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campaign_metrics.functions.text import blank, canonical_slug, display_name, season_label
from campaign_metrics.functions.time import minutes_until
from campaign_metrics.schema import RECENT_ACTIVITY_MINUTES

# ---------------------------------------------------------------- filters ---


def active_now(campaigns: DataFrame, now: Column) -> DataFrame:
    """not archived, live, and starts_at <= now <= ends_at."""
    return campaigns.filter(~F.col("is_archived") & F.col("is_live") & now.between(F.col("starts_at"), F.col("ends_at")))


def public_only(campaigns: DataFrame) -> DataFrame:
    """F3."""
    return campaigns.filter("is_public")


def not_archived(campaigns: DataFrame) -> DataFrame:
    """the campaigns a bulk re-aggregation touches."""
    return campaigns.filter(~F.col("is_archived"))


def search_campaigns(campaigns: DataFrame, term: str) -> DataFrame:
    """case-insensitive substring on alias or slug."""
    pat = f"%{term}%"
    return campaigns.filter(F.col("display_alias").ilike(pat) | F.col("slug").ilike(pat))


def search_sources(sources: DataFrame, term: str) -> DataFrame:
    """case-insensitive substring on name, slug or base URL."""
    pat = f"%{term}%"
    return sources.filter(F.col("name").ilike(pat) | F.col("slug").ilike(pat) | F.col("base_url").ilike(pat))


def flag_filter(df: DataFrame, **flags: bool | None) -> DataFrame:
    """three-state flag filters; None means 'all'."""
    for name, want in flags.items():
        if want is not None:
            df = df.filter(F.col(name) == F.lit(bool(want)))
    return df


def recent_activity(campaigns: DataFrame, checkpoints: DataFrame, now: Column,
                    minutes: int = RECENT_ACTIVITY_MINUTES) -> DataFrame:
    """F7 + J5: campaigns with a checkpoint run in the last ``minutes``."""
    recent = checkpoints.filter(F.col("last_run_at") >= now - F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(minutes), F.lit(0))).select("event_id")
    return campaigns.join(recent, "event_id", "left_semi")


# ------------------------------------------------------------------ joins ---


def ingest_plan(campaigns: DataFrame, bridge: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """One row per (active campaign, enabled bridge row, active source)."""
    act = active_now(campaigns, now).select("event_id", "slug")
    br = bridge.filter("is_enabled").select("event_id", "source_id")
    src = sources.filter("is_active").select("source_id", F.col("slug").alias("source_slug"), "adapter_type")
    return F.broadcast(act).join(br, "event_id").join(F.broadcast(src), "source_id")


def records_with_campaign(records: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Records joined to their campaign (inner)."""
    return records.join(F.broadcast(campaigns.select("event_id", "year", "season", "slug")), "event_id")


def _counts(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def campaign_child_counts(campaigns: DataFrame, records: DataFrame, bridge: DataFrame,
                          rollup: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Each campaign with its child counts, zero included.

    Counts are aggregated per campaign first (partial aggregation), then
    left-joined to the dimension: the fact side never meets the join unreduced.
    """
    out = campaigns.select("event_id", "slug")
    for df, name in ((records, "records_count"), (bridge, "sources_count"),
                     (rollup, "aggregates_count"), (checkpoints, "checkpoints_count")):
        out = out.join(_counts(df, "event_id", name), "event_id", "left").withColumn(
            name, F.coalesce(F.col(name), F.lit(0)))
    return out


def source_child_counts(sources: DataFrame, bridge: DataFrame) -> DataFrame:
    """Each source with the number of campaigns it is attached to."""
    return (sources.select("source_id", "slug").join(_counts(bridge, "source_id", "campaigns_count"), "source_id", "left")
            .withColumn("campaigns_count", F.coalesce(F.col("campaigns_count"), F.lit(0))))


def checkpoint_labels(checkpoints: DataFrame, campaigns: DataFrame, sources: DataFrame) -> DataFrame:
    """Checkpoints with campaign and source slugs, ``unknown-*`` when missing."""
    c = F.broadcast(campaigns.select("event_id", F.col("slug").alias("event_slug")))
    s = F.broadcast(sources.select("source_id", F.col("slug").alias("source_slug")))
    j = checkpoints.join(c, "event_id", "left").join(s, "source_id", "left")
    return j.withColumn("event_slug", F.coalesce("event_slug", F.lit("unknown-event"))).withColumn(
        "source_slug", F.coalesce("source_slug", F.lit("unknown-source")))


def campaigns_with_records(campaigns: DataFrame, records: DataFrame) -> DataFrame:
    """EXISTS (a record of the campaign). Records are reduced to their
    distinct campaign ids first (map-side), so the join meets a tiny side."""
    return campaigns.join(records.select("event_id").distinct(), "event_id", "left_semi")


def campaigns_without_rollup(campaigns: DataFrame, rollup: DataFrame) -> DataFrame:
    """Campaigns with no rollup rows."""
    return campaigns.join(rollup.select("event_id").distinct(), "event_id", "left_anti")


def records_of(records: DataFrame, ids: DataFrame) -> DataFrame:
    """IN-list restriction of a fact scan to a (small) id set."""
    return records.join(F.broadcast(ids.select("event_id")), "event_id", "left_semi")


def source_names_per_campaign(campaigns: DataFrame, bridge: DataFrame, sources: DataFrame) -> DataFrame:
    """Sorted, comma-joined source names per campaign (bridge rows are few per campaign)."""
    j = bridge.join(F.broadcast(sources.select("source_id", "name")), "source_id")
    names = j.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("source_names"))
    return campaigns.select("event_id", "slug").join(names, "event_id", "left")


# ------------------------------------------------------------ aggregates ----


def season_rank(season: Column) -> Column:
    """Spring < fall < anything else."""
    return F.when(season == "spring", F.lit(1)).when(season == "fall", F.lit(2)).otherwise(F.lit(3))


def transactions_per_campaign(campaigns: DataFrame, rollup: DataFrame, records: DataFrame,
                              fallback: str = "rows") -> DataFrame:
    """A5 (+J6, J7, J8, U3, N19, T3): per campaign, the rollup's raw_sum total;
    campaigns without rollup rows fall back to their records: ``fallback='rows'``
    counts rows as the reference does (D4), ``'raw'`` sums raw_count so both
    paths use one unit. Missing -> 0. Joined by id, never by position (D3)."""
    from_rollup = rollup.groupBy("event_id").agg(F.sum("raw_sum").cast("long").alias("total"))
    missing = campaigns.select("event_id").join(from_rollup.select("event_id"), "event_id", "left_anti")
    fb = records_of(records, missing)
    fb_total = F.count(F.lit(1)) if fallback == "rows" else F.sum(F.col("raw_count").cast("long"))
    fb_totals = fb.groupBy("event_id").agg(fb_total.cast("long").alias("total"))
    totals = from_rollup.unionByName(fb_totals)
    out = campaigns.select("event_id", "year", "season", "slug").join(totals, "event_id", "left")
    order = Window.orderBy("year", season_rank(F.col("season")), "slug")
    return out.select(
        "event_id", season_label(F.col("year"), F.col("season")).alias("label"),
        F.coalesce("total", F.lit(0).cast("long")).alias("total_transactions"),
        F.row_number().over(order).alias("position"))


def transactions_per_year(records: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Record count by campaign year (not by timestamp year)."""
    counts = records.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return (counts.join(F.broadcast(campaigns.select("event_id", "year")), "event_id")
            .groupBy("year").agg(F.sum("n").cast("long").alias("transactions")))


def admin_stats(sources: DataFrame, campaigns: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Source totals (active/inactive), campaign total, checkpoints in error.

    One row. Scalar subqueries keep each count its own aggregate without a
    join between unrelated tables.
    """
    s = sources.agg(F.count(F.lit(1)).alias("sources_total"),
                    F.count_if(F.col("is_active")).alias("sources_active"))
    return s.select(
        "sources_total", "sources_active",
        F.greatest(F.lit(0), F.col("sources_total") - F.col("sources_active")).alias("sources_inactive"),
        campaigns.agg(F.count(F.lit(1))).scalar().alias("campaigns_total"),
        checkpoints.agg(F.count_if(F.col("last_status") == "error")).scalar().alias("checkpoints_in_error"))


def observed_window(campaigns: DataFrame, records: DataFrame) -> DataFrame:
    """min/max record time become starts_at/ends_at; no rows -> unchanged."""
    w = records.groupBy("event_id").agg(F.min("timestamp_utc").alias("_min"), F.max("timestamp_utc").alias("_max"))
    j = campaigns.join(w, "event_id", "left")
    return j.select("event_id",
                    F.coalesce("_min", "starts_at").alias("starts_at"),
                    F.coalesce("_max", "ends_at").alias("ends_at"))


def sources_seen(records: DataFrame) -> DataFrame:
    """Distinct (campaign, source) pairs in the records."""
    return records.select("event_id", "source_id").distinct()


def cursor_advance(checkpoints: DataFrame, batch_records: DataFrame) -> DataFrame:
    """New cursor per pair = greatest(previous cursor, latest batch record time)."""
    latest = batch_records.groupBy("event_id", "source_id").agg(F.max("timestamp_utc").alias("batch_max"))
    j = checkpoints.select("event_id", "source_id", "last_seen_timestamp").join(
        latest, ["event_id", "source_id"], "full_outer")
    return j.select("event_id", "source_id",
                    F.greatest("last_seen_timestamp", "batch_max").alias("last_seen_timestamp"))


# ---------------------------------------------------------- listings/top ----


def list_campaigns(campaigns: DataFrame, by: str = "starts_at_desc") -> DataFrame:
    """Listing order made explicit as a position column."""
    order = {"starts_at_desc": [F.col("starts_at").desc(), F.col("event_id")],
             "slug": [F.col("slug"), F.col("event_id")]}[by]
    return campaigns.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def list_sources(sources: DataFrame) -> DataFrame:
    """Sources by name."""
    return sources.withColumn("position", F.row_number().over(Window.orderBy("name", "source_id")))


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """T4: top-1 by last_run_at (TakeOrdered: one row per task, merged)."""
    return checkpoints.orderBy(F.col("last_run_at").desc_nulls_last(), "event_id", "source_id").limit(1)


def first_live_public(campaigns: DataFrame) -> DataFrame:
    """T5: the first live, public campaign by id."""
    return campaigns.filter(F.col("is_live") & F.col("is_public")).orderBy("event_id").limit(1)


def embed_target(campaigns: DataFrame, records: DataFrame) -> DataFrame:
    """T5 + J5: the campaign an embedded chart shows (first live public one)
    and whether it has any record. The records scan is restricted to that one
    campaign by a semi join against the one-row dimension."""
    target = first_live_public(campaigns).select("event_id", "slug")
    seen = records.join(F.broadcast(target.select("event_id")), "event_id", "left_semi").select("event_id").distinct()
    return target.join(seen.withColumn("has_data", F.lit(True)), "event_id", "left").select(
        "event_id", "slug", F.coalesce("has_data", F.lit(False)).alias("has_data"))


def public_index(campaigns: DataFrame, records: DataFrame) -> DataFrame:
    """J3 + T2: public campaigns, newest first, each with its record count (zero included)."""
    counts = records.groupBy("event_id").agg(F.count(F.lit(1)).alias("records_count"))
    listed = list_campaigns(public_only(campaigns).select("event_id", "slug", "starts_at"))
    return listed.join(counts, "event_id", "left").select(
        "event_id", "slug", "starts_at", F.coalesce("records_count", F.lit(0)).alias("records_count"), "position")


def campaign_id_difference(campaigns: DataFrame, rollup: DataFrame) -> DataFrame:
    """All campaign ids minus the aggregated ones."""
    return campaigns.select("event_id").subtract(rollup.select("event_id"))


def health_report(checkpoints: DataFrame, campaigns: DataFrame, sources: DataFrame) -> DataFrame:
    """Latest pair, its status and run time, and checkpoints in error."""
    latest = latest_checkpoint(checkpoint_labels(checkpoints, campaigns, sources))
    errors = checkpoints.agg(F.count_if(F.col("last_status") == "error")).scalar()
    return latest.select(
        F.concat_ws(" / ", "event_slug", "source_slug").alias("latest_pair"),
        F.coalesce("last_status", F.lit("none")).alias("latest_status"),
        "last_run_at", errors.alias("checkpoints_in_error"))


# ---------------------------------------------------------------- labels ----


def directory_attributes(directories: DataFrame, now: Column) -> DataFrame:
    """Campaign attributes from a directory name ``YYYY`` or ``YYYY-suffix``:
    season fall if the suffix contains 'fall' else spring; alias = year when the
    suffix is 'lite'; no match -> the year of ``now`` and no season."""
    d = F.col("directory")
    m = d.rlike(r"^\d{4}(-.+)?$")
    year = F.regexp_extract(d, r"^(\d{4})", 1).try_cast("int")
    suffix = F.lower(F.trim(F.regexp_extract(d, r"^\d{4}-(.+)$", 1)))
    return directories.select(
        "directory",
        F.when(m, year).otherwise(F.year(now)).alias("year"),
        F.when(m, F.when(suffix.contains("fall"), F.lit("fall")).otherwise(F.lit("spring"))).alias("season"),
        F.when(m & (suffix == "lite"), year.cast("string")).alias("display_alias"))


def directory_campaigns(directories: DataFrame, now: Column) -> DataFrame:
    """Campaign rows a historical import upserts, one per (year, season).

    Two directories with the same key (``2020`` and ``2020-lite``) merge; the
    later directory name supplies alias and notes (D10). The window is the
    whole calendar year until A8 narrows it to the observed records.
    """
    attrs = directory_attributes(directories, now)
    per_key = attrs.groupBy("year", "season").agg(
        F.max_by(F.struct("directory", "display_alias"), F.col("directory")).alias("_d"))
    y = F.col("year")
    return per_key.select(
        y.alias("year"), "season",
        F.make_timestamp_ntz(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("starts_at"),
        F.make_timestamp_ntz(y, F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59)).alias("ends_at"),
        F.lit(True).alias("is_public"), F.lit(False).alias("is_live"), F.lit(True).alias("is_archived"),
        F.col("_d.display_alias").alias("display_alias"),
        F.concat(F.lit("Imported from legacy CSVs in "), F.col("_d.directory")).alias("notes"))


def campaign_labels(campaigns: DataFrame) -> DataFrame:
    """Canonical slug, display name and report label."""
    slug = canonical_slug(F.col("year"), F.col("season"))
    return campaigns.select(
        "event_id", slug.alias("canonical_slug"),
        display_name(F.col("display_alias"), slug, F.col("year"), F.col("season")).alias("display_name"),
        season_label(F.col("year"), F.col("season")).alias("report_label"))


def slug_suffixes(campaigns: DataFrame) -> DataFrame:
    """Campaigns sharing a base slug get -2, -3, ... in id order (the
    first keeps the base). Groups are campaigns per slug: tiny."""
    base = canonical_slug(F.col("year"), F.col("season"))
    rn = F.row_number().over(Window.partitionBy("_base").orderBy("event_id"))
    return (campaigns.withColumn("_base", base)
            .withColumn("_rn", rn)
            .select("event_id", "slug",
                    F.when(F.col("_rn") > 1, F.concat("_base", F.lit("-"), F.col("_rn").cast("string")))
                    .otherwise(F.col("_base")).alias("new_slug"),
                    (F.col("year").isNull() | blank(F.col("season"))).alias("skipped")))


def free_slugs(campaigns: DataFrame) -> DataFrame:
    """W6 against all stored slugs: event_id, slug, new_slug, skipped.

    Campaigns with year and season are renamed in id order, each to the base
    slug or the base with the smallest suffix from 2 on that nobody else has at
    that time: neither one renamed before it (its old slug is free then), nor
    one that keeps its slug or is renamed later. Slugs of other bases and of
    campaigns that are skipped hold their place, too, if they look like a
    suffix of this base. One group is one base slug with its campaigns and the
    holders of its suffixes.
    """
    base = canonical_slug(F.col("year"), F.col("season"))
    skipped = F.col("year").isNull() | blank(F.col("season"))
    rows = campaigns.select("event_id", "slug", base.alias("base"), skipped.alias("skipped"))
    suffix = F.regexp_extract("slug", "-([1-9][0-9]{0,8})$", 1).try_cast("long")
    held = rows.filter("slug is not null").select(
        "event_id", "skipped", F.explode(F.array(
            F.struct(F.col("slug").alias("base"), F.lit(1).cast("long").alias("k")),
            F.struct(F.regexp_replace("slug", "-[0-9]+$", "").alias("base"), F.when(suffix > 1, suffix).alias("k")))).alias("h"))
    members = rows.filter("not skipped").select("base", "event_id", F.lit(None).cast("long").alias("k"), F.lit(True).alias("leaves"))
    holders = held.filter("h.k is not null").select("h.base", "event_id", "h.k", (~F.col("skipped")).alias("leaves"))

    def first_free(group: pd.DataFrame) -> pd.DataFrame:
        mine = sorted(group.loc[group["k"].isna(), "event_id"].tolist())
        taken = Counter(group["k"].dropna().astype("int64").tolist())
        leaving = sorted((e, int(k)) for e, k, goes in zip(group["event_id"], group["k"], group["leaves"]) if goes and k == k)
        found, gone = [], 0
        for event in mine:
            while gone < len(leaving) and leaving[gone][0] <= event:  # renamed by now, or this one's own
                taken[leaving[gone][1]] -= 1
                gone += 1
            k = 1
            while taken[k] > 0:
                k += 1
            taken[k] += 1
            found.append((event, k))
        return pd.DataFrame(found, columns=["event_id", "n"]).astype("int64")

    free = members.unionByName(holders).groupBy("base").applyInPandas(first_free, "event_id bigint, n bigint")
    new = F.when(F.col("n") > 1, F.concat_ws("-", "base", F.col("n").cast("string"))).otherwise(F.col("base"))
    return rows.join(free, "event_id", "left").select("event_id", "slug", F.when(~F.col("skipped"), new).alias("new_slug"), "skipped")


def slug_backfill_report(suffixed: DataFrame) -> DataFrame:
    """How many stored slugs change, how many rows are skipped (incomplete, or already right)."""
    changes = ~F.col("skipped") & ~F.col("slug").eqNullSafe(F.col("new_slug"))
    return suffixed.agg(F.count_if(changes).alias("updated"), F.count_if(~changes).alias("skipped"))


def zone_views(campaigns: DataFrame, wall_zone: str = "Pacific/Tongatapu",
               display_zone: str = "America/New_York") -> DataFrame:
    """A window entered as wall time in ``wall_zone`` -> UTC; UTC ->
    ``display_zone`` for display; hour labels in UTC and in the chosen zone."""
    from campaign_metrics.functions.time import utc_to_wall, wall_to_utc

    return campaigns.select(
        "event_id",
        wall_to_utc(F.col("starts_at"), wall_zone).alias("starts_at_from_wall"),
        utc_to_wall(F.col("starts_at"), display_zone).alias("starts_at_display"),
        F.date_format("starts_at", "yyyy-MM-dd HH:00").alias("starts_hour_label"),
        F.date_format(utc_to_wall(F.col("starts_at"), display_zone), "yyyy-MM-dd HH:00").alias("starts_hour_label_local"))


def no_data_state(campaigns: DataFrame, records: DataFrame, now: Column) -> DataFrame:
    """Message state for public campaigns without records: countdown
    (hours, minutes) for a live campaign not yet started, 'waiting' once it
    started, 'unavailable' when not live."""
    empty = campaigns.filter("is_public").join(records.select("event_id").distinct(), "event_id", "left_anti")
    mins = minutes_until(now, F.col("starts_at"))
    future = F.col("is_live") & (now < F.col("starts_at"))
    state = (F.when(future, F.lit("countdown")).when(F.col("is_live"), F.lit("waiting"))
             .otherwise(F.lit("unavailable")))
    return empty.select("event_id", state.alias("state"),
                        F.when(future, F.floor(mins / 60)).cast("long").alias("hours"),
                        F.when(future, mins % 60).cast("long").alias("minutes"))


__all__ = [n for n in dir() if not n.startswith("_")]
