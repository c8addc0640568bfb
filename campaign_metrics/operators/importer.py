"""Historical CSV rows -> canonical records.

Header aliases are resolved at plan time, per header shape: the reference
addresses each cell by the header's original, lower-case and snake forms,
later columns overwriting earlier ones for a shared form. The resolved
positions become plain column references, so the per-row work is native
expressions only (trim/upper/rlike/coalesce/sha2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campaign_metrics.functions.keys import bounded_raw_count, bounded_work_unit, dedupe_key, ingest_order
from campaign_metrics.functions.text import (display_name, first_filled, first_numeric, header_forms,
                                             normalize_header)
from campaign_metrics.functions.time import parse_utc
from campaign_metrics.schema import (CSV_COUNT_ALIASES, CSV_DESCRIPTION_ALIASES, CSV_GUID_ALIASES,
                                     CSV_PROJECT_ALIASES, CSV_TIMESTAMP_ALIASES, CSV_WEIGHT_ALIASES,
                                     DEFAULT_SOURCE_SLUG, FILE_SOURCE_ALIASES, SOURCE_LABELS,
                                     TEXT_SOURCE_ALIASES)
from campaign_metrics.sources.history import discover_csv_files, read_shapes


def form_index(header: tuple[str, ...]) -> dict[str, int]:
    """Form -> position of the last column answering to it."""
    idx: dict[str, int] = {}
    for i, h in enumerate(header):
        if h is None or h == "":
            continue
        for form in (h, h.lower(), normalize_header(h)):
            idx[form] = i
    return idx


def alias_columns(header: tuple[str, ...], keys) -> list[Column]:
    """The columns an ordered alias list reads, in lookup order (key, then its forms)."""
    idx = form_index(header)
    cols: list[Column] = []
    for key in keys:
        for cand in header_forms(key):
            if cand in idx:
                cols.append(F.col(f"_c{idx[cand]}"))
    return cols


def text_source_slug(text: Column) -> Column:
    """First text alias contained in the trimmed lower-case text."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    expr = None
    for needle, slug in TEXT_SOURCE_ALIASES:
        cond = t.contains(needle)
        expr = F.when(cond, F.lit(slug)) if expr is None else expr.when(cond, F.lit(slug))
    return F.when(t != "", expr)


def file_source_slug(stem: Column) -> Column:
    """Exact lower-case file stem alias."""
    m = F.create_map(*[x for k, v in FILE_SOURCE_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, F.lower(stem))


def source_label(slug: Column) -> Column:
    m = F.create_map(*[x for k, v in SOURCE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, slug)


def map_shape(header: tuple[str, ...], df: DataFrame) -> DataFrame:
    """N11-N14 for one header shape: the fields every CSV record needs."""
    def first(keys):
        return first_filled(alias_columns(header, keys))

    stem = F.regexp_replace(F.col("file_name"), r"\.csv$", "")
    center_col = first(("center",))
    desc_col = first(("description",))
    is_ddf = F.lower(stem) == "ddf"
    slug = F.coalesce(
        F.when(is_ddf, F.coalesce(text_source_slug(center_col), text_source_slug(desc_col)))
         .otherwise(file_source_slug(stem)),
        F.lit(DEFAULT_SOURCE_SLUG))
    # Canonical row JSON for the fallback guid (D14: path relative to the base).
    row_json = F.to_json(F.struct(*[F.col(f"_c{i}").alias(h or f"_{i}") for i, h in enumerate(header)]))
    guid = F.coalesce(first(CSV_GUID_ALIASES),
                      F.sha2(F.concat_ws("|", F.col("relative_path"), row_json), 256))
    return df.select(
        "campaign_dir", "file_name", "file_path", "file_order", "block_start", "row_order",
        first(CSV_TIMESTAMP_ALIASES).alias("ts_text"),
        guid.alias("source_guid"),
        first(CSV_PROJECT_ALIASES).alias("project"),
        center_col.alias("center_value"),
        first(CSV_DESCRIPTION_ALIASES).alias("description"),
        first_numeric(alias_columns(header, CSV_WEIGHT_ALIASES), 1.0).alias("work_unit_value"),
        first_numeric(alias_columns(header, CSV_COUNT_ALIASES), 1.0).alias("raw_count_value"),
        slug.alias("source_slug"),
        row_json.alias("payload_json"),
    )


def history_files(spark: SparkSession, base: str, campaign: str | None = None) -> DataFrame:
    """(campaign_dir, file_name) of every importable file, those without a row included."""
    files = discover_csv_files(spark, base, campaign)
    return spark.createDataFrame([(f.campaign, f.name) for f in files], "campaign_dir string, file_name string")


def read_history_rows(spark: SparkSession, base: str, campaign: str | None = None,
                      multiline: bool = True) -> DataFrame:
    """S2 + U2: every importable row of every header shape, mapped and unioned."""
    files = discover_csv_files(spark, base, campaign)
    base_uri = files[0].path[: files[0].path.index(files[0].campaign) - 1] if files else base
    parts = []
    for header, df in read_shapes(spark, files, multiline=multiline):
        df = df.withColumn("relative_path", F.regexp_replace(F.col("file_path"), "^" + _re_escape(base_uri) + "/?", ""))
        parts.append(map_shape(header, df))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def history_records(rows: DataFrame, campaigns_by_dir: DataFrame, sources: DataFrame) -> DataFrame:
    """N13 + N15 + N7 (reject) + N8/N9: mapped CSV rows -> canonical records.

    ``campaigns_by_dir``: (campaign_dir, event_id, display_alias, slug, year,
    season); ``sources``: (source_id, slug). Rows without a timestamp or with
    an unparseable one are dropped, as the reference does for CSV input.
    """
    c = F.broadcast(campaigns_by_dir)
    s = F.broadcast(sources.select("source_id", F.col("slug").alias("source_slug")))
    j = rows.join(c, "campaign_dir").join(s, "source_slug", "left")
    ts = parse_utc(F.col("ts_text"), on_bad="reject")
    project = F.col("project")
    center = F.coalesce(F.col("center_value"), source_label(F.col("source_slug")),
                        F.when(project != "", project),
                        display_name(F.col("display_alias"), F.col("slug"), F.col("year"), F.col("season")))
    out = j.filter(F.col("ts_text").isNotNull()).select(
        F.col("event_id").cast("long").alias("event_id"),
        F.col("source_id").cast("long").alias("source_id"),
        "source_guid", center.alias("center"), "project", "description",
        ts.alias("timestamp_utc"),
        bounded_work_unit(F.col("work_unit_value")).alias("work_unit"),
        bounded_raw_count(F.when(F.col("raw_count_value") >= 0, F.floor("raw_count_value"))
                          .otherwise(F.ceil("raw_count_value"))).alias("raw_count"),
        "payload_json", "campaign_dir", "file_name", "file_path",
        # Import order: later files, then later rows, win on a repeated key.
        ingest_order(page="file_order", part="file_path", block="block_start", pos="row_order").alias("ingest_seq"),
    ).filter(F.col("timestamp_utc").isNotNull())
    return out.withColumn("dedupe_key", dedupe_key())


def import_stats(rows: DataFrame, records: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A10 (+D12): per campaign directory: files, rows read, records accepted,
    rows rejected, and the note for a directory without records. ``files``
    (``history_files``) gives the directories and files; without it those that have rows count."""
    named = (rows if files is None else files).groupBy("campaign_dir").agg(F.count_distinct("file_name").alias("files"))
    read = rows.groupBy("campaign_dir").agg(F.count(F.lit(1)).alias("rows_read"))
    acc = records.groupBy("campaign_dir").agg(F.count(F.lit(1)).alias("records"))
    j = named.join(read, "campaign_dir", "left").join(acc, "campaign_dir", "left").fillna(0, ["rows_read", "records"])
    return j.select("campaign_dir", "files", "rows_read", "records",
                    (F.col("rows_read") - F.col("records")).alias("rejected"),
                    F.when(F.col("records") == 0, F.concat(
                        F.lit("Imported from legacy CSVs in "), F.col("campaign_dir"),
                        F.lit(". No transcription rows were available for this event year."))).alias("note"))
