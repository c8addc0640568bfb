"""End-to-end jobs over a Store: the reference's commands as Spark jobs.

- ``import_history``: CSV tree -> campaigns (N16, M4, A8), legacy sources (M5),
  records (M1), bridge (M6), rollup (A1/M2); returns the import statistics (A10).
- ``rebuild_rollups``: bulk re-aggregation of non-archived campaigns (F4, D17).
- ``health``: latest checkpoint pair and error count (R6).
- ``delete``: campaigns and sources with everything that hangs off them (J10).
- ``backfill_slugs``: canonical slugs with the smallest free suffix (W6).

Each step reads and writes whole tables through the Store; nothing passes
through the driver except table names and the small campaign dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campaign_metrics.functions.time import ts_literal
from campaign_metrics.operators import importer, reports, upsert
from campaign_metrics.session import staged
from campaign_metrics.sources.store import Store


def _now(now: str | None) -> Column:
    return ts_literal(now) if now else F.current_timestamp().cast("timestamp_ntz")


def import_history(spark: SparkSession, base: str, store: Store, campaign: str | None = None,
                   now: str | None = None, multiline: bool = True) -> DataFrame:
    """Import a historical CSV tree into the store; returns A10 statistics per directory."""
    when = _now(now)
    rows = importer.read_history_rows(spark, base, campaign, multiline=multiline).persist()
    try:
        files = importer.history_files(spark, base, campaign)
        dirs = files.select(F.col("campaign_dir").alias("directory")).distinct()
        campaigns = upsert.upsert_campaigns(store.read("campaigns"), reports.directory_campaigns(dirs, when))
        sources = upsert.fill_source_defaults(store.read("sources"), upsert.legacy_source_defaults(spark))
        store.write("sources", sources)
        sources = store.read("sources")
        attrs = reports.directory_attributes(dirs, when).alias("d")
        by_dir = attrs.join(campaigns.alias("c"), (F.col("d.year") == F.col("c.year"))
                            & F.col("d.season").eqNullSafe(F.col("c.season"))).select(
            F.col("d.directory").alias("campaign_dir"), "c.event_id", "c.display_alias", "c.slug", "c.year",
            "c.season")
        recs = importer.history_records(rows, by_dir, sources).persist()
        try:
            incoming = recs.withColumn("created_at", when).withColumn("updated_at", when).select(
                *upsert.RECORD_COLUMNS)
            store.apply_batch(incoming)
            # The observed window replaces the placeholder calendar year.
            windowed = reports.observed_window(campaigns, recs.select("event_id", "timestamp_utc"))
            campaigns = campaigns.drop("starts_at", "ends_at").join(windowed, "event_id")
            notes = importer.import_stats(rows, recs, files).select("campaign_dir", F.col("note").alias("_note"))
            empty = by_dir.join(notes.filter(F.col("_note").isNotNull()), "campaign_dir").select(
                "event_id", "_note")
            campaigns = campaigns.join(empty, "event_id", "left").withColumn(
                "notes", F.coalesce("_note", "notes")).drop("_note")
            store.write("campaigns", campaigns)
            store.write("bridge", upsert.upsert_bridge(store.read("bridge"), reports.sources_seen(recs)))
            return importer.import_stats(rows, recs, files)
        finally:
            recs.unpersist()
    finally:
        rows.unpersist()


def rebuild_rollups(store: Store, include_archived: bool = False) -> None:
    """Bulk re-aggregation: every (campaign, day) of the selected campaigns."""
    camps = store.read("campaigns")
    store.rebuild_rollup(camps if include_archived else reports.not_archived(camps))


def health(store: Store) -> DataFrame:
    return reports.health_report(store.read("checkpoints"), store.read("campaigns"), store.read("sources"))


def delete(store: Store, campaigns: list[int] = (), sources: list[int] = ()) -> DataFrame:
    """Delete by id, persisted; returns what hung off the campaigns (see ``upsert.delete_impact``)."""
    spark = store.spark
    event_ids = spark.createDataFrame([(int(i),) for i in campaigns], "event_id bigint")
    source_ids = spark.createDataFrame([(int(i),) for i in sources], "source_id bigint")
    tables = {name: store.read(name) for name in ("records", "rollup", "checkpoints", "bridge")}
    impact = staged(upsert.delete_impact(tables, event_ids), "delete-impact")
    store.delete(event_ids if campaigns else None, source_ids if sources else None)
    return impact


def backfill_slugs(store: Store) -> DataFrame:
    """Rewrite changed slugs (campaigns missing year or season are skipped);
    returns the updated/skipped counts."""
    camps = store.read("campaigns")
    suffixed = reports.free_slugs(camps).persist()
    try:
        report = reports.slug_backfill_report(suffixed).collect()[0]
        fixed = camps.join(suffixed.select("event_id", "new_slug", "skipped"), "event_id").withColumn(
            "slug", F.when(F.col("skipped"), F.col("slug")).otherwise(F.col("new_slug"))).drop("new_slug", "skipped")
        store.write("campaigns", fixed)
        return camps.sparkSession.createDataFrame([(report.updated, report.skipped)], "updated long, skipped long")
    finally:
        suffixed.unpersist()
