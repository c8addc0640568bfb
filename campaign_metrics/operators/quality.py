"""Data-quality audits (Q1-Q7): each returns the violating rows with a rule id.

Form rules of the reference become table audits. Every check is a filter, a
grouped count or an anti join; none gathers a table onto one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaign_metrics.schema import ALLOWED_ADAPTERS, ALLOWED_SEASONS
from campaign_metrics.sources.feeds import FAMILIES

VIOLATION_COLS = ["rule", "table_name", "row_key", "detail"]


def _v(df: DataFrame, rule: str, table: str, key, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"),
                     key.cast("string").alias("row_key"), detail.cast("string").alias("detail"))


def _dupes(df: DataFrame, cols: list[str], rule: str, table: str) -> DataFrame:
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])
    return _v(g, rule, table, key, F.concat(F.lit("count="), F.col("n").cast("string")))


def _dupes_by_hash(df: DataFrame, key: str, rule: str, table: str) -> DataFrame:
    """Exact duplicate check of a wide key on a fact table in two passes.

    Pass 1 shuffles only an 8-byte hash per row (with map-side counting), so
    the 64-character keys never cross the network; pass 2 re-checks the exact
    key for the rows whose hash repeats (hash collisions drop out there).
    """
    h = F.xxhash64(F.col(key)).alias("_h")
    repeated = df.select(h).groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h")
    candidates = df.select(key, F.xxhash64(F.col(key)).alias("_h")).join(repeated, "_h", "left_semi")
    return _dupes(candidates.select(key), [key], rule, table)


def unique_keys(campaigns: DataFrame, bridge: DataFrame, records: DataFrame) -> DataFrame:
    """Q1: (year, season), slug, (campaign, source) and dedupe_key are unique."""
    return (_dupes(campaigns, ["year", "season"], "Q1", "campaigns")
            .unionByName(_dupes(campaigns, ["slug"], "Q1", "campaigns"))
            .unionByName(_dupes(bridge, ["event_id", "source_id"], "Q1", "bridge"))
            .unionByName(_dupes_by_hash(records, "dedupe_key", "Q1", "records")))


def single_live(campaigns: DataFrame) -> DataFrame:
    """Q2: at most one live campaign (live rows flagged when there are several)."""
    n_live = campaigns.filter("is_live").agg(F.count(F.lit(1))).scalar()
    live = campaigns.filter("is_live").withColumn("_n", n_live)
    return _v(live.filter("_n > 1"), "Q2", "campaigns", F.col("event_id"),
              F.concat(F.lit("live campaigns="), F.col("_n").cast("string")))


def window_consistency(campaigns: DataFrame) -> DataFrame:
    """Q3: start and end in the campaign year, end in the start year, end after start."""
    c = campaigns
    checks = [
        (F.year("starts_at") != F.col("year"), "start year differs from campaign year"),
        (F.year("ends_at") != F.col("year"), "end year differs from campaign year"),
        (F.year("ends_at") != F.year("starts_at"), "end not in the start year"),
        (F.col("ends_at") <= F.col("starts_at"), "end not after start"),
    ]
    parts = [_v(c.filter(cond), "Q3", "campaigns", F.col("event_id"), F.lit(msg)) for cond, msg in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def required_and_ranges(campaigns: DataFrame, sources: DataFrame) -> DataFrame:
    """Q4: year in 2000-2100; required fields; text lengths."""
    c = campaigns
    parts = [
        _v(c.filter(~F.col("year").between(2000, 2100) | F.col("year").isNull()), "Q4", "campaigns",
           F.col("event_id"), F.lit("year outside 2000-2100")),
        _v(c.filter(F.col("starts_at").isNull() | F.col("ends_at").isNull()), "Q4", "campaigns",
           F.col("event_id"), F.lit("missing start or end")),
        _v(c.filter(F.length("display_alias") > 255), "Q4", "campaigns", F.col("event_id"),
           F.lit("display alias longer than 255")),
        _v(sources.filter(F.col("name").isNull() | (F.trim("name") == "")), "Q4", "sources", F.col("source_id"),
           F.lit("missing name")),
        _v(sources.filter(F.col("slug").isNull() | (F.trim("slug") == "")), "Q4", "sources", F.col("source_id"),
           F.lit("missing slug")),
        _v(sources.filter(F.length("name") > 255), "Q4", "sources", F.col("source_id"), F.lit("name longer than 255")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def allowed_values(campaigns: DataFrame, sources: DataFrame) -> DataFrame:
    """Q5: season and adapter type inside their allowed sets."""
    bad_season = campaigns.filter(F.col("season").isNotNull() & ~F.col("season").isin(*ALLOWED_SEASONS))
    bad_adapter = sources.filter(F.col("adapter_type").isNull() | ~F.col("adapter_type").isin(*ALLOWED_ADAPTERS))
    return (_v(bad_season, "Q5", "campaigns", F.col("event_id"), F.concat(F.lit("season="), F.col("season")))
            .unionByName(_v(bad_adapter, "Q5", "sources", F.col("source_id"),
                            F.concat(F.lit("adapter_type="), F.coalesce("adapter_type", F.lit("NULL"))))))


URL_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+([/?#]\S*)?$"


def _broken_rules(df: DataFrame, table: str, key: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """The rules that each row breaks, as rows; a rule whose condition is unknown (null) is not broken.

    One scan however many rules there are: every row carries the array of its broken rules, which is exploded.
    """
    named = F.array(*[F.when(broken, F.struct(F.lit(rule).alias("rule"), F.lit(detail).alias("detail")))
                      for rule, broken, detail in rules])
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.explode(F.filter(named, lambda r: r.isNotNull())).alias("r"))
    return rows.select("r.rule", F.lit(table).alias("table_name"), "row_key", "r.detail")


def _missing(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def form_rules(campaigns: DataFrame, sources: DataFrame) -> DataFrame:
    """Q3-Q5: every rule of the campaign and source forms in one pass over each table."""
    start, end, year = F.col("starts_at"), F.col("ends_at"), F.col("year")
    of_campaigns = [
        ("Q3", F.year(start) != year, "start year differs from campaign year"),
        ("Q3", F.year(end) != year, "end year differs from campaign year"),
        ("Q3", F.year(end) != F.year(start), "end not in the start year"),
        ("Q3", end <= start, "end not after start"),
        ("Q4", year.isNull(), "missing year"),
        ("Q4", ~year.between(2000, 2100), "year outside 2000-2100"),
        ("Q4", _missing("season"), "missing season"),
        ("Q4", _missing("slug"), "missing slug"),
        ("Q4", F.length("slug") > 255, "slug longer than 255"),
        ("Q4", F.length("display_alias") > 255, "display alias longer than 255"),
        ("Q4", start.isNull(), "missing start"),
        ("Q4", end.isNull(), "missing end"),
        ("Q5", ~_missing("season") & ~F.col("season").isin(*ALLOWED_SEASONS), "season not allowed"),
    ]
    types = [t for family in FAMILIES.values() for t in family.types]
    of_sources = [
        ("Q4", _missing("name"), "missing name"),
        ("Q4", F.length("name") > 255, "name longer than 255"),
        ("Q4", _missing("slug"), "missing slug"),
        ("Q4", F.length("slug") > 255, "slug longer than 255"),
        ("Q4", _missing("adapter_type"), "missing adapter type"),
        ("Q4", F.length("base_url") > 500, "base url longer than 500"),
        ("Q4", ~_missing("base_url") & ~F.col("base_url").rlike(URL_PATTERN), "base url is no url"),
        ("Q5", ~_missing("adapter_type") & ~F.col("adapter_type").isin(*types), "adapter type not allowed"),
    ]
    return _broken_rules(campaigns, "campaigns", "event_id", of_campaigns).unionByName(
        _broken_rules(sources, "sources", "source_id", of_sources))


def record_bounds(candidates: DataFrame) -> DataFrame:
    """Q6: raw_count in 1-255 and work_unit fits decimal(10,4).

    ``candidates`` carries unconverted ``work_unit_value`` (double) and
    ``raw_count_value`` (long) next to ``dedupe_key``.
    """
    too_wide = F.col("work_unit_value").try_cast("decimal(10,4)").isNull() & F.col("work_unit_value").isNotNull()
    out_of_range = ~F.col("raw_count_value").between(1, 255)
    return (_v(candidates.filter(out_of_range), "Q6", "records", F.col("dedupe_key"),
               F.concat(F.lit("raw_count="), F.col("raw_count_value").cast("string")))
            .unionByName(_v(candidates.filter(too_wide), "Q6", "records", F.col("dedupe_key"),
                            F.lit("work_unit does not fit decimal(10,4)"))))


def referential_integrity(children: dict[str, DataFrame], campaigns: DataFrame, sources: DataFrame) -> DataFrame:
    """Q7: child rows whose campaign or source does not exist (anti joins to
    the small parents; the child side is never shuffled for it)."""
    parts = []
    c_ids = F.broadcast(campaigns.select("event_id"))
    s_ids = F.broadcast(sources.select("source_id"))
    for name, df in children.items():
        if "event_id" in df.columns:
            orphan = df.join(c_ids, "event_id", "left_anti")
            parts.append(_v(orphan, "Q7", name, F.col("event_id"), F.lit("unknown campaign")))
        if "source_id" in df.columns:
            orphan = df.join(s_ids, "source_id", "left_anti")
            parts.append(_v(orphan, "Q7", name, F.col("source_id"), F.lit("unknown source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
