"""Keyed upserts as union -> keyed aggregate.

Plain Parquet has no MERGE, so each upsert is: union old and new rows with an
explicit order (old before new, then ``ingest_seq``), reduce per key with
``max_by`` (a partial aggregate: a key repeated a million times is combined
map-side, never gathered into one task), then rewrite the touched partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaign_metrics.functions.text import canonical_slug
from campaign_metrics.schema import ERROR_MESSAGE_LIMIT, INGEST_ORDER, LEGACY_SOURCE_URLS, LEGACY_SOURCES

# Columns an ingest replaces on a repeated dedupe key; created_at is kept.
REPLACED = ("center", "project", "description", "timestamp_utc", "work_unit", "raw_count",
            "payload_json", "updated_at")
RECORD_COLUMNS = ("event_id", "source_id", "source_guid", "dedupe_key", "center", "project", "description",
                  "timestamp_utc", "work_unit", "raw_count", "payload_json", "created_at", "updated_at",
                  "ingest_seq")


def _order(generation: Column, seq: Column) -> Column:
    return F.struct(generation.alias("g"), seq.alias("s"))


def keep_last(df: DataFrame, key: str = "dedupe_key", seq: str = "ingest_seq") -> DataFrame:
    """Inside one batch, the row with the highest ``seq`` wins per key (equal ones: the greater payload)."""
    cols = [c for c in df.columns if c != key]
    order = F.struct(seq, *[c for c in ("payload_json",) if c in cols])
    picked = df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]).select(*df.columns)


def upsert_records(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """M1: records after applying ``incoming`` onto ``existing``.

    Per dedupe_key the latest incoming version (by ``ingest_seq``) replaces
    the stored row; ``created_at`` stays the first-seen value. Stored rows are
    never regrouped: they stream through a semi join (to fetch the first-seen
    time of re-sent keys) and an anti join (rows the batch does not touch)
    against the batch's keys, which AQE broadcasts when the batch is small.
    Only the batch itself is shuffled by key. ``existing`` should be limited
    to the partitions the batch touches (see ``Store.touched``).
    """
    return merge_records(existing, keep_last(incoming.select(*RECORD_COLUMNS)))


def merge_records(existing: DataFrame, new: DataFrame) -> DataFrame:
    """M1 for a batch that holds every key once."""
    cols = list(RECORD_COLUMNS)
    keys = new.select("dedupe_key")
    first_seen = existing.join(keys, "dedupe_key", "left_semi").select(
        "dedupe_key", F.col("created_at").alias("_first_seen"))
    updated = (new.join(first_seen, "dedupe_key", "left")
               .withColumn("created_at", F.coalesce(F.col("_first_seen"), F.col("created_at")))
               .select(*cols))
    untouched = existing.select(*cols).join(keys, "dedupe_key", "left_anti")
    return untouched.unionByName(updated)


def record_digest() -> Column:
    """SHA-256 of all that an upsert would store of a record: its columns but ``created_at``, every one with its length."""
    order = [F.col("ingest_seq")[f.name] for f in INGEST_ORDER.fields]
    texts = [c.cast("string") for c in (*[F.col(c) for c in RECORD_COLUMNS if c not in ("created_at", "ingest_seq")], *order)]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def touched_campaigns(incoming: DataFrame) -> DataFrame:
    """The campaign ids a batch touches (tiny; broadcast for partition pruning)."""
    return incoming.select("event_id").distinct()


def rebuild_rollup(rollup: DataFrame, records: DataFrame, touched: DataFrame) -> DataFrame:
    """M2: the rollup with every touched campaign recomputed from its records.

    Stricter than the reference's keyed upsert: buckets that vanished are
    dropped too, because the touched campaign is rewritten whole (D7). The
    store's incremental path (``Store.apply_batch``) recomputes touched slices only.
    """
    from campaign_metrics.operators.rollup import hourly_rollup

    t = F.broadcast(touched.select("event_id"))
    kept = rollup.join(t, "event_id", "left_anti")
    fresh = hourly_rollup(records.join(t, "event_id", "left_semi"))
    return kept.unionByName(fresh.select(*rollup.columns))


def advance_checkpoints(checkpoints: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """M3 + A11: per (campaign, source) ingest state after a batch.

    ``batch`` has one row per pair: ``max_ts`` (latest record time, may be
    NULL), ``next_page_token``, ``error`` (NULL when the pair's pages were
    ingested). ok -> cursor = greatest(old cursor, max_ts), token, run time,
    error cleared. error -> status and message (cut to 2000 chars), cursor
    untouched. Pairs without a checkpoint start as pending.
    """
    keys = ["event_id", "source_id"]
    j = checkpoints.join(batch, keys, "full_outer")
    ok = F.col("error").isNull()
    ran = F.col("max_ts").isNotNull() | F.col("error").isNotNull() | F.col("next_page_token").isNotNull()
    cursor = F.when(ok, F.greatest(F.col("last_seen_timestamp"), F.col("max_ts"))).otherwise(F.col("last_seen_timestamp"))
    return j.select(
        *keys,
        F.when(ran, cursor).otherwise(F.col("last_seen_timestamp")).alias("last_seen_timestamp"),
        F.when(ran & ok, F.col("next_page_token")).when(ran, F.col("last_page_token"))
         .otherwise(F.col("last_page_token")).alias("last_page_token"),
        F.when(ran, now).otherwise(F.col("last_run_at")).alias("last_run_at"),
        F.when(ran & ok, F.lit("ok")).when(ran, F.lit("error"))
         .otherwise(F.coalesce(F.col("last_status"), F.lit("pending"))).alias("last_status"),
        F.when(ran & ok, F.lit(None).cast("string")).when(ran, F.substring(F.col("error"), 1, ERROR_MESSAGE_LIMIT))
         .otherwise(F.col("last_error")).alias("last_error"),
    )


def upsert_campaigns(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """M4: campaigns keyed by (year, season), NULL season matching NULL.

    Incoming values replace the window, flags, alias and notes; new keys get
    ids after the current maximum, numbered in (year, season) order. Campaigns
    are a small dimension (one row per campaign directory), so numbering the
    new ones in a single ordered window is bounded.
    """
    from pyspark.sql.window import Window

    fields = ["starts_at", "ends_at", "is_public", "is_live", "is_archived", "display_alias", "notes"]
    o, n = existing.alias("o"), incoming.alias("n")
    cond = (F.col("o.year") == F.col("n.year")) & F.col("o.season").eqNullSafe(F.col("n.season"))
    j = o.join(n, cond, "full_outer")
    is_new = F.col("o.event_id").isNull()
    out = j.select(
        F.col("o.event_id").alias("event_id"), is_new.alias("_new"),
        F.coalesce(F.col("o.year"), F.col("n.year")).alias("year"),
        F.when(is_new, F.col("n.season")).otherwise(F.col("o.season")).alias("season"),
        *[F.when(F.col("n.year").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fields],
    )
    max_id = existing.agg(F.coalesce(F.max("event_id"), F.lit(-1)).cast("long")).scalar()
    rank = F.row_number().over(Window.orderBy("year", F.col("season").asc_nulls_first()))
    fresh = out.filter("_new").withColumn("event_id", (max_id + rank).cast("long"))
    cols = ["event_id", "year", "season", *fields]
    res = out.filter("NOT _new").select(*cols).unionByName(fresh.select(*cols))
    return res.withColumn("slug", canonical_slug(F.col("year"), F.col("season")))


def legacy_source_defaults(spark, details: dict[str, tuple[str | None, str | None]] | None = None) -> DataFrame:
    """The six legacy sources' defaults (a fixed table).

    ``details`` gives base URL and notes by slug: they belong to a deployment, and replace ``LEGACY_SOURCE_URLS``.
    """
    more = {**{slug: (url, None) for slug, url in LEGACY_SOURCE_URLS.items()}, **(details or {})}
    rows = [(slug, *vals, *more.get(slug, (None, None))) for slug, vals in LEGACY_SOURCES.items()]
    return spark.createDataFrame(rows, "slug string, name string, adapter_type string, supports_weighting boolean, "
                                       "is_active boolean, weight_field string, base_url string, notes string")


def fill_source_defaults(existing: DataFrame, defaults: DataFrame) -> DataFrame:
    """M5: a stored non-empty value wins over the default, base URL and notes
    included; booleans take the default only for new rows. Keyed by slug."""
    o, d = existing.alias("o"), defaults.alias("d")
    j = o.join(d, F.col("o.slug") == F.col("d.slug"), "full_outer")
    is_new = F.col("o.slug").isNull()

    def keep_filled(c):
        return F.coalesce(F.nullif(F.col(f"o.{c}"), F.lit("")), F.col(f"d.{c}"))

    from pyspark.sql.window import Window

    max_id = existing.agg(F.coalesce(F.max("source_id"), F.lit(-1)).cast("long")).scalar()
    # New sources (a handful of legacy slugs) are numbered after the current maximum.
    new_id = (max_id + F.row_number().over(Window.partitionBy(is_new).orderBy(F.col("d.slug")))).cast("long")
    return j.select(
        F.when(is_new, new_id).otherwise(F.col("o.source_id")).alias("source_id"),
        F.coalesce(F.col("o.slug"), F.col("d.slug")).alias("slug"),
        keep_filled("name").alias("name"),
        keep_filled("adapter_type").alias("adapter_type"),
        F.when(is_new, F.col("d.supports_weighting")).otherwise(F.col("o.supports_weighting")).alias("supports_weighting"),
        F.when(is_new, F.col("d.is_active")).otherwise(F.col("o.is_active")).alias("is_active"),
        keep_filled("weight_field").alias("weight_field"),
        *[keep_filled(c).alias(c) if c in defaults.columns else F.col(f"o.{c}").alias(c)
          for c in ("base_url", "notes") if c in existing.columns],
    )


def upsert_bridge(bridge: DataFrame, seen: DataFrame) -> DataFrame:
    """M6: pairs seen in a batch become enabled (added if new); others keep their flag."""
    s = seen.select("event_id", "source_id").distinct().withColumn("_seen", F.lit(True))
    j = bridge.join(s, ["event_id", "source_id"], "full_outer")
    return j.select("event_id", "source_id",
                    F.when(F.col("_seen"), F.lit(True)).otherwise(F.col("is_enabled")).alias("is_enabled"))


def cascade_delete(tables: dict[str, DataFrame], campaign_ids: DataFrame | None = None,
                   source_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Remove deleted campaigns/sources and everything hanging off them.

    Children of a campaign: records, rollup, checkpoints, bridge. Children of
    a source: records, checkpoints, bridge (the rollup hangs off campaigns only).
    """
    out = dict(tables)
    by_campaign = {"records", "rollup", "checkpoints", "bridge", "campaigns"}
    by_source = {"records", "checkpoints", "bridge", "sources"}
    for name, df in tables.items():
        if campaign_ids is not None and name in by_campaign:
            df = df.join(F.broadcast(campaign_ids.select("event_id")), "event_id", "left_anti")
        if source_ids is not None and name in by_source:
            df = df.join(F.broadcast(source_ids.select("source_id")), "source_id", "left_anti")
        out[name] = df
    return out


def delete_impact(tables: dict[str, DataFrame], campaign_ids: DataFrame) -> DataFrame:
    """Rows a campaign deletion would remove, per child table (J3 counts)."""
    parts = []
    for name in ("records", "rollup", "checkpoints", "bridge"):
        if name in tables:
            parts.append(tables[name].join(F.broadcast(campaign_ids.select("event_id")), "event_id", "left_semi")
                         .groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name)))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


__all__: Sequence[str] = ["keep_last", "upsert_records", "merge_records", "record_digest", "rebuild_rollup", "advance_checkpoints",
                          "upsert_campaigns", "fill_source_defaults", "upsert_bridge", "cascade_delete"]
