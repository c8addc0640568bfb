"""Canonical table schemas and the fixed values the semantics depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for right results).
# ---------------------------------------------------------------------------
SEASON_SPRING = "spring"
SEASON_FALL = "fall"
ALLOWED_SEASONS = ("spring", "fall")

ADAPTER_GENERIC = ("api_json", "http_json")
ADAPTER_BIOSPEX = "biospex_json"
ADAPTER_DIGIVOL = "digivol_json"
ALLOWED_ADAPTERS = ("api_json", "http_json", "biospex_json", "digivol_json")

# Brand word that leads every canonical slug and display name. A deployment
# parameter: pass its own brand to canonical_slug/display_name.
SLUG_PREFIX = "Campaign"
FEED_PAGE_SIZE = 100
ERROR_MESSAGE_LIMIT = 2000
RECENT_ACTIVITY_MINUTES = 5
MINUTE_BUCKET_WINDOW_MINUTES = 60
SNAPSHOT_MAX_AGE_SECONDS = 900
STATUS_PENDING, STATUS_OK, STATUS_ERROR = "pending", "ok", "error"

# Record array key search order per adapter family.
FEED_ARRAY_KEYS = {
    "generic": ("data", "items", "records"),
    "digivol": ("items", "records", "data"),
    "biospex": ("items",),
}
# Next-page token paths of the generic feed.
GENERIC_NEXT_TOKEN_PATHS = ("next_page_token", "meta.next_page_token", "links.next")

# Weight paths per adapter when a source has no weight_field.
GENERIC_WEIGHT_PATHS = ("work_unit", "workUnit")
DIGIVOL_WEIGHT_PATHS = ("work_unit", "workUnit", "discretionaryState.workUnit")
BIOSPEX_WEIGHT_PATHS = ("discretionaryState.workUnit", "discretionarystate_workunit")

# Historical CSV import: default source, file-stem aliases, text aliases
# (checked in this order), canonical center labels per source slug.
DEFAULT_SOURCE_SLUG = "notes-from-nature"
FILE_SOURCE_ALIASES = {
    "final-citems": "citsciscribe",
    "citems": "citsciscribe",
    "final-sitems": "smithsonian",
    "sitems": "smithsonian",
    "final-sitcitems": "smithsonian",
    "sitcitems": "smithsonian",
    "final-digitems": "digivol",
    "digitems": "digivol",
    "final-heritems": "les-herbonautes",
    "heritems": "les-herbonautes",
    "final-n4items": "notes-from-nature",
    "n4items": "notes-from-nature",
}
TEXT_SOURCE_ALIASES = (
    ("doedat", "doedat"),
    ("digivol", "digivol"),
    ("herbonaut", "les-herbonautes"),
    ("sitc", "smithsonian"),
    ("smithsonian", "smithsonian"),
    ("citsciscribe", "citsciscribe"),
    ("notes from nature", "notes-from-nature"),
    ("biospex", "notes-from-nature"),
)
SOURCE_LABELS = {
    "digivol": "DigiVol",
    "les-herbonautes": "Les herbonautes",
    "smithsonian": "SITC",
    "notes-from-nature": "Notes From Nature",
    "citsciscribe": "CitSciScribe",
    "doedat": "DoeDat",
}
# Legacy source defaults: slug -> (name, adapter_type, supports_weighting, is_active, weight_field).
LEGACY_SOURCES = {
    "digivol": ("DigiVol", "digivol_json", False, True, None),
    "les-herbonautes": ("Les Herbonautes", "api_json", True, False, "discretionaryState.workUnit"),
    "smithsonian": ("Smithsonian Transcription Center", "api_json", False, False, None),
    "notes-from-nature": ("Notes From Nature (BioSpex)", "biospex_json", False, True, None),
    "doedat": ("DoeDat", "api_json", False, False, None),
    "citsciscribe": ("CitSciScribe", "api_json", False, False, None),
}
# Base URLs of legacy sources; a deployment passes those of the others.
LEGACY_SOURCE_URLS = {
    "digivol": "http://volunteer.ala.org.au/ws/transcriptionFeed.json",
    "les-herbonautes": "http://lesherbonautes.mnhn.fr/contributions/interval/json",
    "doedat": "https://www.doedat.be/ws/transcriptionFeed.json",
}

# CSV column aliases, in priority order.
CSV_TIMESTAMP_ALIASES = ("timestamp", "timestamp_utc", "created_at", "completed_at", "transcribed_at", "time")
CSV_GUID_ALIASES = ("guid", "id", "uuid")
CSV_PROJECT_ALIASES = ("project", "project.name", "project_name", "projectid", "project_id")
CSV_DESCRIPTION_ALIASES = ("description", "subject.description")
CSV_WEIGHT_ALIASES = ("discretionaryState.workUnit", "discretionaryState_workUnit",
                      "discretionarystate_workunit", "work_unit", "workUnit")
CSV_COUNT_ALIASES = ("raw_count", "rawCount")
CSV_MISSING_TOKENS = ("", "NA")

# ---------------------------------------------------------------------------
# Canonical schemas
# ---------------------------------------------------------------------------
WORK_UNIT = T.DecimalType(10, 4)
# The reference stores decimal(14,4); sums are kept at Spark's widened (20,4) so an
# ANSI-mode cast can never overflow on a very large bucket.
WEIGHTED_SUM = T.DecimalType(20, 4)

# Which of two versions of a record is the later one: fetch time, page (or file), part file, split, position.
INGEST_ORDER = T.StructType([
    T.StructField("at", T.TimestampNTZType()),
    T.StructField("page", T.LongType()),
    T.StructField("part", T.StringType()),
    T.StructField("block", T.LongType()),
    T.StructField("pos", T.LongType()),
])

RECORDS = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("source_id", T.LongType(), False),
    T.StructField("source_guid", T.StringType()),
    T.StructField("dedupe_key", T.StringType(), False),
    T.StructField("center", T.StringType(), False),
    T.StructField("project", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("timestamp_utc", T.TimestampNTZType(), False),
    T.StructField("work_unit", WORK_UNIT),
    T.StructField("raw_count", T.ShortType()),
    T.StructField("payload_json", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("ingest_seq", INGEST_ORDER),
])

CAMPAIGNS = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("slug", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("season", T.StringType()),
    T.StructField("starts_at", T.TimestampNTZType()),
    T.StructField("ends_at", T.TimestampNTZType()),
    T.StructField("is_public", T.BooleanType()),
    T.StructField("is_live", T.BooleanType()),
    T.StructField("is_archived", T.BooleanType()),
    T.StructField("display_alias", T.StringType()),
    T.StructField("notes", T.StringType()),
])

SOURCES = T.StructType([
    T.StructField("source_id", T.LongType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("slug", T.StringType()),
    T.StructField("base_url", T.StringType()),
    T.StructField("adapter_type", T.StringType()),
    T.StructField("supports_weighting", T.BooleanType()),
    T.StructField("weight_field", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("notes", T.StringType()),
])

EVENT_SOURCE = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("source_id", T.LongType(), False),
    T.StructField("is_enabled", T.BooleanType()),
])

CHECKPOINTS = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("source_id", T.LongType(), False),
    T.StructField("last_seen_timestamp", T.TimestampNTZType()),
    T.StructField("last_page_token", T.StringType()),
    T.StructField("last_run_at", T.TimestampNTZType()),
    T.StructField("last_status", T.StringType()),
    T.StructField("last_error", T.StringType()),
])

ROLLUP = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("bucket_hour_utc", T.TimestampNTZType(), False),
    T.StructField("center", T.StringType(), False),
    T.StructField("weighted_sum", WEIGHTED_SUM),
    T.StructField("raw_sum", T.LongType()),
])

# One landed feed page = one JSON Lines row.
LANDED_PAGE = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("source_id", T.LongType()),
    T.StructField("page_offset", T.LongType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
    T.StructField("body", T.StringType()),
])

# A landed page that was not ingested, with the reason and its text; one partition per ingest batch.
QUARANTINE = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("source_id", T.LongType()),
    T.StructField("page_offset", T.LongType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
    T.StructField("reason", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("batch", T.LongType()),
])
