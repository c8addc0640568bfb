"""Driver tables -> canonical tables.

The driver ships TPC-H-like parquet tables plus an ``events`` stream. These
bindings put them into the canonical shapes (records, campaigns, sources, the
campaign/source bridge, checkpoints, the rollup and landed feed pages). The
same expressions are written in DuckDB SQL in ``plans.oracle`` so each
registered query can be checked against an independent engine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaign_metrics.functions.keys import dedupe_key, ingest_order
from campaign_metrics.functions.text import canonical_slug
from campaign_metrics.functions.time import iso_seconds, ts_literal
from campaign_metrics.schema import FEED_PAGE_SIZE, WORK_UNIT
from campaign_metrics.session import ensure_utc

# Fixed parameters of the bindings (shared with plans/oracle.py).
NOW = "2024-01-21 00:30:00"          # the 'now' every time-dependent query uses
WINDOW_ORIGIN = "2024-01-01 00:00:00"  # campaign k runs from origin + 5k days ...
WINDOW_END = "2024-01-10 23:59:59"     # ... until end + 5k days
FETCH_ORIGIN = "2024-02-01 00:00:00"   # landed pages: fetched at origin + page minutes


def _days(n) -> F.Column:
    return F.make_dt_interval(n, F.lit(0), F.lit(0), F.lit(0))


def _seconds(n) -> F.Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)


def events_base(events: DataFrame) -> DataFrame:
    """Common projection of the driver ``events`` table."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return events.select(
        F.col("event_id").alias("src_id"), "ts", "user_id", "event_type", "value", "props",
        k.alias("k"),
        (F.col("user_id") % 5).cast("long").alias("event_id"),
        (F.col("user_id") % 25).cast("long").alias("source_id"),
    )


def records_from_events(events: DataFrame) -> DataFrame:
    """``records``: one canonical record per driver event."""
    b = events_base(events)
    project = F.when(F.col("k") % 10 != 0, F.concat(F.lit("p"), (F.col("k") % 7).cast("string")))
    out = b.select(
        "event_id", "source_id",
        F.col("src_id").cast("string").alias("source_guid"),
        F.col("event_type").alias("center"),
        project.alias("project"),
        F.lit(None).cast("string").alias("description"),
        F.col("ts").alias("timestamp_utc"),
        (F.col("value") / 10).cast(WORK_UNIT).alias("work_unit"),
        (F.lit(1) + F.col("k") % 3).cast("short").alias("raw_count"),
        F.col("props").alias("payload_json"),
        (F.col("ts") + _seconds(F.col("src_id") % 90)).alias("created_at"),
        ingest_order(pos="src_id").alias("ingest_seq"),
    )
    return out.withColumn("dedupe_key", dedupe_key()).withColumn("updated_at", F.col("created_at"))


def records_from_lineitem(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """``records_large``: lineitem x supplier x nation as records (bench scale).

    Supplier grows with the data, so its join strategy is left to the planner
    (size-checked broadcast or AQE conversion); nation is a fixed 25-row table.
    """
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    sup = supplier.select("s_suppkey", "s_nationkey")
    nat = F.broadcast(nation.select("n_nationkey", "n_name"))
    j = li.join(sup, li.l_suppkey == sup.s_suppkey).join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
    ts = F.col("l_shipdate") + _seconds(F.col("l_orderkey") % 86400)
    out = j.select(
        (F.year("l_shipdate") % 5).cast("long").alias("event_id"),
        F.col("s_nationkey").cast("long").alias("source_id"),
        # (orderkey, linenumber) repeats in the driver's lineitem; with part and supplier it is unique.
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
        .alias("source_guid"),
        F.col("n_name").alias("center"),
        F.lit(None).cast("string").alias("project"),
        F.lit(None).cast("string").alias("description"),
        ts.alias("timestamp_utc"),
        F.col("l_quantity").cast(WORK_UNIT).alias("work_unit"),
        F.col("l_linenumber").cast("short").alias("raw_count"),
        F.lit(None).cast("string").alias("payload_json"),
        ts.alias("created_at"),
        ingest_order(pos=F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ingest_seq"),
    )
    return out.withColumn("dedupe_key", dedupe_key()).withColumn("updated_at", F.col("created_at"))


def campaigns_from_region(region: DataFrame) -> DataFrame:
    k = F.col("r_regionkey")
    season = F.when(k % 2 == 0, F.lit("spring")).otherwise(F.lit("fall"))
    year = (F.lit(2020) + k).cast("int")
    return region.select(
        k.cast("long").alias("event_id"),
        canonical_slug(year, season).alias("slug"),
        year.alias("year"),
        season.alias("season"),
        (ts_literal(WINDOW_ORIGIN) + _days(k * 5)).alias("starts_at"),
        (ts_literal(WINDOW_END) + _days(k * 5)).alias("ends_at"),
        (k != 3).alias("is_public"),
        (k == 4).alias("is_live"),
        (k < 4).alias("is_archived"),
        F.when(k == 1, F.col("r_name")).alias("display_alias"),
        F.lit(None).cast("string").alias("notes"),
    )


def sources_from_nation(nation: DataFrame) -> DataFrame:
    n = F.col("n_nationkey")
    adapter = (F.when(n % 3 == 0, F.lit("api_json"))
               .when(n % 3 == 1, F.lit("biospex_json"))
               .otherwise(F.lit("digivol_json")))
    return nation.select(
        n.cast("long").alias("source_id"),
        F.col("n_name").alias("name"),
        F.regexp_replace(F.lower("n_name"), " ", "-").alias("slug"),
        F.lit(None).cast("string").alias("base_url"),
        adapter.alias("adapter_type"),
        F.lit(True).alias("supports_weighting"),
        F.when(n % 5 == 0, F.lit("k")).alias("weight_field"),
        (n % 4 != 0).alias("is_active"),
        F.lit(None).cast("string").alias("notes"),
    )


def bridge_from_nation(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_regionkey").cast("long").alias("event_id"),
        F.col("n_nationkey").cast("long").alias("source_id"),
        (F.col("n_nationkey") % 2 == 0).alias("is_enabled"),
    )


def checkpoints_from(bridge: DataFrame, records: DataFrame) -> DataFrame:
    """Ingest state per bridge pair: cursor = latest record time of the pair."""
    seen = records.groupBy("event_id", "source_id").agg(F.max("timestamp_utc").alias("last_seen_timestamp"))
    j = bridge.select("event_id", "source_id").join(seen, ["event_id", "source_id"], "left")
    status = (F.when(F.col("last_seen_timestamp").isNull(), F.lit("pending"))
              .when(F.col("source_id") % 7 == 0, F.lit("error")).otherwise(F.lit("ok")))
    return j.select(
        "event_id", "source_id", "last_seen_timestamp",
        F.lit(None).cast("string").alias("last_page_token"),
        (F.col("last_seen_timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1), F.lit(0))).alias("last_run_at"),
        status.alias("last_status"),
        F.when(status == "error", F.lit("HTTP 500 from feed")).alias("last_error"),
    )


def feed_items(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Per driver event, the JSON item its source's feed would have served.

    Generic feeds use ``data`` envelopes and flat fields; biospex pages put the
    weight under ``discretionaryState``; digivol nests the project name.
    Every few items miss a required field, so the per-adapter filters bite.
    """
    b = events_base(events)
    src = F.broadcast(sources.select("source_id", "adapter_type"))
    b = b.join(src, "source_id")
    project = F.when(F.col("k") % 10 != 0, F.concat(F.lit("p"), (F.col("k") % 7).cast("string")))
    iso_micro_z = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    iso_offset = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    weight = F.col("value") / 10
    raw = F.lit(1) + F.col("k") % 3
    even = F.col("src_id") % 2 == 0
    generic = F.to_json(F.struct(
        F.col("src_id").cast("string").alias("id"),
        F.when(F.col("k") % 13 != 0, F.col("event_type")).alias("center"),
        project.alias("project"),
        F.when(even, iso_micro_z).alias("timestamp_utc"),
        F.when(~even, iso_offset).alias("timestamp"),
        weight.alias("work_unit"), (F.col("k") % 3).alias("raw_count"), F.col("k").alias("k"),
    ))
    biospex = F.to_json(F.struct(
        F.concat(F.lit("g-"), F.col("src_id").cast("string")).alias("guid"),
        F.col("event_type").alias("project"),
        F.concat(F.lit("subject "), F.col("src_id").cast("string")).alias("description"),
        iso_offset.alias("timestamp"),
        F.struct(weight.alias("workUnit")).alias("discretionaryState"),
        F.col("k").alias("k"),
    ))
    digivol = F.to_json(F.struct(
        F.col("src_id").cast("string").alias("id"),
        F.when(project.isNotNull(), F.struct(project.alias("name"))).alias("project"),
        F.concat(F.lit("subject "), F.col("src_id").cast("string")).alias("description"),
        iso_micro_z.alias("timestamp"),
        weight.alias("workUnit"), raw.alias("raw_count"), F.col("k").alias("k"),
    ))
    item = (F.when(F.col("adapter_type") == "biospex_json", biospex)
            .when(F.col("adapter_type") == "digivol_json", digivol).otherwise(generic))
    return b.select("event_id", "source_id", "adapter_type", "src_id",
                    F.floor(F.col("src_id") / FEED_PAGE_SIZE).cast("long").alias("page_offset"),
                    item.alias("item"))


def feed_pages(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Landed pages: one JSON document per (campaign, source, page), at most 100 items.

    Grouping is by page, so every group is bounded by the page size.
    """
    items = feed_items(events, sources)
    pages = items.groupBy("event_id", "source_id", "adapter_type", "page_offset").agg(
        F.sort_array(F.collect_list(F.struct("src_id", "item"))).alias("entries"))
    arr = F.concat(F.lit("["), F.array_join(F.transform("entries", lambda e: e["item"]), ","), F.lit("]"))
    # Per-pair totals as an aggregate joined back (no window over a possibly hot pair), counted before any item is
    # written as JSON. There are as many as (campaign, source) pairs, so the pages are not shuffled again.
    pair_stats = items.groupBy("event_id", "source_id").agg(
        F.count(F.lit(1)).alias("_num_found"), F.max("page_offset").alias("_last_page"))
    pages = pages.join(F.broadcast(pair_stats), ["event_id", "source_id"])
    total = F.col("_num_found")
    next_token = F.when(F.col("page_offset") < F.col("_last_page"), F.col("page_offset") + 1)
    body = (F.when(F.col("adapter_type") == "biospex_json",
                   F.concat(F.lit('{"items":'), arr, F.lit(',"start":'), (F.col("page_offset") * FEED_PAGE_SIZE).cast("string"),
                            F.lit(',"rows":'), F.lit(str(FEED_PAGE_SIZE)), F.lit(',"numFound":'), total.cast("string"), F.lit("}")))
            .when(F.col("adapter_type") == "digivol_json", F.concat(F.lit('{"items":'), arr, F.lit("}")))
            .otherwise(F.concat(F.lit('{"data":'), arr, F.lit(',"next_page_token":'),
                                F.coalesce(F.concat(F.lit('"'), next_token.cast("string"), F.lit('"')), F.lit("null")),
                                F.lit("}"))))
    return pages.select(
        "event_id", "source_id", "page_offset",
        (ts_literal(FETCH_ORIGIN) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("page_offset"), F.lit(0))).alias("fetched_at"),
        body.alias("body"),
    )


# Fixed faults of the derived landing by fault number; the other numbers are good pages.
PAGE_FAULTS = {0: "broken line", 1: "repeated key", 2: "unparseable timestamp", 3: "value out of range", 4: "unreadable body",
               5: "unknown source", 6: None}  # 6: a page without items
FAULT_KINDS = 11
UNKNOWN_SOURCE_OFFSET = 1000
BROKEN_LINE_CHARS = 60
_BAD_TIME = '{"id":"x","guid":"x","center":"x","timestamp":"not a time"},'
_TOO_LARGE = ('{"id":"y","guid":"y","center":"y","timestamp":"2024-01-01T00:00:00Z","work_unit":1e9,"k":1e9,'
              '"discretionaryState":{"workUnit":1e9}},')


def page_fault() -> F.Column:
    """Fault number of a landed page: pairs of source 3, 13, 23 have empty pages only, those of 7 and 17 bad times only."""
    digit = F.col("source_id") % 10
    return (F.when(digit == 3, 6).when(digit == 7, 2)
            .otherwise((F.col("event_id") + F.col("source_id") * 3 + F.col("page_offset")) % FAULT_KINDS))


def faulty_landing(pages: DataFrame) -> DataFrame:
    """The landed pages as JSON lines (event_id, value), many of them with a fault that keeps the page from being read."""
    kind, body = F.col("_fault"), F.col("body")

    def with_item(item: str):
        return F.regexp_replace(body, r'^\{"(data|items)":\[', F.lit('{"$1":[' + item))

    spoilt = (F.when(kind == 1, F.concat(F.lit('{"again":1,"again":2,'), F.expr("substring(body, 2)")))
              .when(kind == 2, with_item(_BAD_TIME)).when(kind == 3, with_item(_TOO_LARGE))
              .when(kind == 4, F.expr("left(body, length(body) - 5)"))
              .when(kind == 6, F.lit('{"data":[],"items":[]}')).otherwise(body))
    line = F.to_json(F.struct(
        (F.col("source_id") + F.when(kind == 5, UNKNOWN_SOURCE_OFFSET).otherwise(0)).alias("source_id"), "page_offset",
        F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"), spoilt.alias("body")))
    return pages.withColumn("_fault", page_fault()).select(
        "event_id", "page_offset", F.when(kind == 0, F.left(line, F.lit(BROKEN_LINE_CHARS))).otherwise(line).alias("value"))


def tokened_pages(pages: DataFrame) -> DataFrame:
    """The landed pages, those of generic feeds (source % 3 = 0) with opaque tokens; one page in 29 has not landed."""
    def opaque(offset):
        return F.left(F.sha2(F.concat_ws("|", "event_id", "source_id", offset), 256), F.lit(16))

    generic = F.col("source_id") % 3 == 0
    named = F.regexp_replace("body", r'"next_page_token":"[0-9]+"', F.concat(
        F.lit('"next_page_token":"'), opaque(F.col("page_offset") + 1), F.lit('"')))
    token = F.when(generic & (F.col("page_offset") > 0), opaque(F.col("page_offset")))
    return (pages.withColumn("body", F.when(generic, named).otherwise(F.col("body"))).withColumn("page_token", token)
            .filter((F.col("event_id") + F.col("source_id") + F.col("page_offset")) % 29 != 17))


REPLAY_SEQ_OFFSET = 10 ** 12


def replay_batch(records: DataFrame) -> DataFrame:
    """Upsert batch 2: records with k % 4 = 0 again, work_unit doubled, a later
    ingest_seq and a later first-seen time (which the upsert must not keep)."""
    k = F.get_json_object("payload_json", "$.k").try_cast("int")
    again = records.filter(k % 4 == 0)
    return (again.withColumn("work_unit", (F.col("work_unit") * 2).cast(WORK_UNIT))
            .withColumn("ingest_seq", F.col("ingest_seq").withField("pos", F.col("ingest_seq.pos") + F.lit(REPLAY_SEQ_OFFSET)))
            .withColumn("created_at", F.col("created_at") + _days(F.lit(1)))
            .withColumn("updated_at", F.col("created_at")))


def campaign_directories(orders: DataFrame, events: DataFrame) -> DataFrame:
    """Historical campaign directory names: one per order year (with a season
    suffix by year) plus the year of the events stream."""
    y = F.year("o_orderdate")
    from_orders = orders.select(y.alias("y")).distinct().select(
        F.when(F.col("y") % 3 == 0, F.col("y").cast("string"))
         .when(F.col("y") % 3 == 1, F.concat(F.col("y").cast("string"), F.lit("-fall")))
         .otherwise(F.concat(F.col("y").cast("string"), F.lit("-lite"))).alias("directory"))
    from_events = events.select(F.year("ts").cast("string").alias("directory")).distinct()
    return from_orders.unionByName(from_events).distinct()


def extra_directories(region: DataFrame) -> DataFrame:
    """Directory names that do not follow the ``YYYY[-suffix]`` pattern."""
    return region.select(F.col("r_name").alias("directory"))


_MATERIALIZED: dict = {}


@dataclass
class Tables:
    """Lazily bound canonical tables for one scale-factor directory."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def __post_init__(self):
        ensure_utc(self.spark)

    def raw(self, name: str) -> DataFrame:
        key = ("raw", name)
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        return self._cache[key]

    def _get(self, key, build):
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    def materialized(self, key, build):
        """Like ``_get`` but shared by every Tables of this session and folder:
        for results written to the shared folder (stream runs, CSV trees), so
        several queries over one run do not repeat it."""
        k = (self.spark.sparkContext.applicationId, self.sf_dir, key)
        if k not in _MATERIALIZED:
            _MATERIALIZED[k] = build()
        return _MATERIALIZED[k]

    @property
    def records(self) -> DataFrame:
        return self._get("records", lambda: records_from_events(self.raw("events")))

    @property
    def records_large(self) -> DataFrame:
        return self._get("records_large", lambda: records_from_lineitem(
            self.raw("lineitem"), self.raw("supplier"), self.raw("nation")))

    @property
    def campaigns(self) -> DataFrame:
        return self._get("campaigns", lambda: campaigns_from_region(self.raw("region")))

    @property
    def sources(self) -> DataFrame:
        return self._get("sources", lambda: sources_from_nation(self.raw("nation")))

    @property
    def bridge(self) -> DataFrame:
        return self._get("bridge", lambda: bridge_from_nation(self.raw("nation")))

    @property
    def checkpoints(self) -> DataFrame:
        return self._get("checkpoints", lambda: checkpoints_from(self.bridge, self.records))

    @property
    def rollup(self) -> DataFrame:
        """The stored rollup: aggregation has run for archived campaigns only."""
        from campaign_metrics.operators.rollup import hourly_rollup

        def build():
            done = self.campaigns.filter("is_archived").select("event_id")
            return hourly_rollup(self.records.join(F.broadcast(done), "event_id", "left_semi"))
        return self._get("rollup", build)

    @property
    def feed_pages(self) -> DataFrame:
        return self._get("feed_pages", lambda: feed_pages(self.raw("events"), self.sources))

    @property
    def replay(self) -> DataFrame:
        return self._get("replay", lambda: replay_batch(self.records))

    @property
    def directories(self) -> DataFrame:
        return self._get("directories", lambda: campaign_directories(self.raw("orders"), self.raw("events")))

    @property
    def now(self) -> F.Column:
        return ts_literal(NOW)


__all__ = ["Tables", "NOW", "iso_seconds"]


# --- historical CSV tree derived from events --------------------------------------

# Fixed layout of the derived CSV tree.
CSV_DIRS = ["2024", "2024-fall", "2024-lite"]
CSV_NEWDATA_DIRS = {"2024", "2024-lite"}
CSV_FILES = ["final-digItems.csv", "final-sitcItems.csv", "ddf.csv", "n4Items.csv", "readme.csv"]
CSV_HEADERS = {
    "final-digItems.csv": ["guid", "project", "description", "timestamp", "discretionaryState.workUnit", "subject.link"],
    "final-sitcItems.csv": ["guid", "project", "description", "timestamp", "discretionaryState.workUnit", "subject.link"],
    "n4Items.csv": ["guid", "project", "description", "timestamp", "discretionaryState.workUnit", "subject.link"],
    "ddf.csv": ["project", "description", "guid", "timestamp", "center", "discretionaryState.workUnit", "ID", "id"],
    "readme.csv": ["guid", "timestamp", "notes"],
}
DDF_TEXT = {  # event_type -> (center cell, description cell)
    "click": ("DigiVol", "transcribed via DigiVol"),
    "view": ("", "Notes from Nature expedition"),
    "error": ("NA", "misc"),
    "signup": ("SITC Center", "Smithsonian SITC task"),
    "purchase": ("Les herbonautes", "herbonaut sheets"),
}


def csv_rows(events: DataFrame) -> DataFrame:
    """One CSV row per driver event, with its campaign directory and file name."""
    b = events_base(events)
    sid = F.col("src_id").cast("string")
    k = F.col("k")
    ftype = F.element_at(F.array(*[F.lit(x) for x in CSV_FILES]), ((F.col("user_id") / 3).cast("long") % 5 + 1).cast("int"))
    cdir = F.element_at(F.array(*[F.lit(x) for x in CSV_DIRS]), (F.col("user_id") % 3 + 1).cast("int"))
    fmt = F.col("src_id") % 4
    ts_text = (F.when(k % 19 == 0, F.lit(""))
               .when(k % 17 == 0, F.lit("n/a"))
               .when(fmt == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
               .when(fmt == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
               .when(fmt == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
               .otherwise(F.date_format(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(2), F.lit(0), F.lit(0)),
                                        "yyyy-MM-dd'T'HH:mm:ss'+02:00'")))
    weight = (F.when(k % 23 == 0, F.lit("NaN")).when(k % 29 == 0, F.lit("5d")).when(k % 31 == 0, F.lit(""))
              .otherwise(F.format_string("%.4f", F.col("value") / 10)))
    project = F.when(k % 10 == 0, F.lit("NA")).otherwise(F.concat(F.lit("p"), (k % 7).cast("string")))
    items_desc = F.when(k % 37 == 0, F.concat(F.lit("subject "), sid, F.lit("\nsecond line"))).otherwise(
        F.concat(F.lit("subject "), sid, F.lit(", sheet")))
    et = F.col("event_type")
    ddf_center = F.coalesce(*[F.when(et == t, F.lit(v[0])) for t, v in DDF_TEXT.items()])
    ddf_desc = F.coalesce(*[F.when(et == t, F.lit(v[1])) for t, v in DDF_TEXT.items()])
    guid = F.concat(F.lit("e"), sid)
    items_vals = [guid, project, items_desc, ts_text, weight, F.concat(F.lit("http://x/"), sid)]
    ddf_vals = [project, ddf_desc, F.when(k % 11 == 0, F.lit("")).otherwise(guid), ts_text, ddf_center, weight,
                F.concat(F.lit("ID-"), sid), F.concat(F.lit("id-"), sid)]
    readme_vals = [guid, ts_text, F.lit("ignored")]
    cols = []
    for i in range(8):
        def at(vals):
            return vals[i] if i < len(vals) else F.lit(None).cast("string")
        cols.append(F.when(ftype == "ddf.csv", at(ddf_vals)).when(ftype == "readme.csv", at(readme_vals))
                    .otherwise(at(items_vals)).alias(f"_{i}"))
    return b.select(cdir.alias("campaign_dir"), ftype.alias("file_name"), *cols)


def write_history_tree(events: DataFrame, base: str) -> str:
    """Write the derived CSV tree under ``base`` (a folder in the shared checkpoint dir)."""
    from campaign_metrics.sources.history import write_csv_tree

    write_csv_tree(csv_rows(events), base, "campaign_dir", "file_name", CSV_NEWDATA_DIRS, CSV_HEADERS)
    return base
