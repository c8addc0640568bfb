"""Feed adapters: landed items -> canonical records.

Each adapter is a set of column expressions over one parsed item (VARIANT)
and its source row. ``normalize_items`` applies all of them in a single
projection with a CASE on the adapter family, so one scan of the pages serves
every adapter type; unknown types raise. ``register_adapter`` adds a family: its
types, array keys, item mapping and next-page rule.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaign_metrics.functions.json_paths import (dynamic_path, variant_first, variant_is_string,
                                                   variant_nested, variant_path, variant_texts)
from campaign_metrics.functions.keys import bounded_raw_count, bounded_work_unit, dedupe_key, ingest_order
from campaign_metrics.functions.text import blank, is_numeric, truthy
from campaign_metrics.functions.time import parse_utc
from campaign_metrics.schema import (BIOSPEX_WEIGHT_PATHS, DIGIVOL_WEIGHT_PATHS, FEED_PAGE_SIZE, GENERIC_NEXT_TOKEN_PATHS,
                                     GENERIC_WEIGHT_PATHS)
from campaign_metrics.sources.feeds import FAMILIES, Family, explode_items, family_of, unreadable_pages

Read = Callable[..., Column]
Reads = dict[str, Column] | Column  # what was read of an item, by name: columns, or one struct

# PHP numeric prefix of a string: what (float)/(int) casts keep.
_FLOAT_PREFIX = r"^\s*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)"
_INT_PREFIX = r"^\s*([+-]?[0-9]+)"


def php_float(text: Column, null_default: float) -> Column:
    """``(float) ($x ?? default)``: NULL -> default; leading numeric prefix, else 0."""
    num = F.regexp_extract(text, _FLOAT_PREFIX, 1).try_cast("double")  # "" where there is no prefix: null
    return F.coalesce(num, F.when(text.isNull(), F.lit(null_default)).otherwise(F.lit(0.0)))


def php_int(text: Column, null_default: int) -> Column:
    """``(int) ($x ?? default)`` for integer or float text."""
    f = F.regexp_extract(text, _FLOAT_PREFIX, 1).try_cast("double")
    return F.coalesce(F.when(f >= 0, F.floor(f)).cast("long"), F.ceil(f).cast("long"),
                      F.regexp_extract(text, _INT_PREFIX, 1).try_cast("long"),
                      F.when(text.isNull(), F.lit(null_default).cast("long")).otherwise(F.lit(0).cast("long")))


def numeric_or(text: Column, default: float) -> Column:
    """``is_numeric($x) ? (float) $x : default`` (NULL counts as missing -> default)."""
    return F.when(is_numeric(text), F.trim(text).try_cast("double")).otherwise(F.lit(default))


def weight_value(item: Column, default: Column) -> Column:
    """A source's ``weight_field`` is the only path when set (a miss stays
    NULL, no fallback); otherwise the adapter's default paths in order."""
    configured = ~blank(F.col("weight_field"))
    return F.when(configured, dynamic_path(item, F.col("weight_field"))).otherwise(default)


# An adapter is two steps: what it reads of an item, and the record fields made of that. Reads are named values, so that the
# steps over them need not read the item again (``operators/pages.py`` maps items where nothing shares equal expressions).
# ``read`` gives the first value over dotted paths.

def _generic_reads(v: Column, item: Column, read: Read) -> dict[str, Column]:
    return {
        "ts": read("timestamp_utc", "timestamp"),
        "center": read("center"),
        "guid": F.coalesce(read("source_guid", "guid", "id"), F.sha2(item, 256)),
        "project": read("project"),
        "description": read("description"),
        "weight": weight_value(item, read(*GENERIC_WEIGHT_PATHS)),
        "count": read("raw_count", "rawCount"),
    }


def _generic(r: Reads) -> dict[str, Column]:
    """Generic JSON feed."""
    return {
        "ts_text": r["ts"],
        "center": r["center"],
        "keep": ~blank(r["ts"]) & ~blank(r["center"]),
        "source_guid": r["guid"],
        "project": r["project"],
        "description": r["description"],
        "work_unit": php_float(r["weight"], 1.0),
        "raw_count": php_int(r["count"], 1),
    }


def _biospex_reads(v: Column, item: Column, read: Read) -> dict[str, Column]:
    return {
        "ts": read("timestamp"),
        "guid": read("guid"),
        "project": read("project"),
        "project_is_text": variant_is_string(v, "project"),
        "description": read("description"),
        "weight": F.coalesce(weight_value(item, read(*BIOSPEX_WEIGHT_PATHS)), F.lit("1")),
    }


def _biospex(r: Reads) -> dict[str, Column]:
    """Biospex feed; center = first truthy of project, source name, slug."""
    return {
        "ts_text": r["ts"],
        "center": F.coalesce(truthy(r["project"]), truthy(F.col("source_name")), F.col("source_slug"), F.lit("")),
        "keep": ~blank(r["ts"]) & ~blank(r["guid"]),
        "source_guid": r["guid"],
        "project": F.when(r["project_is_text"], r["project"]),
        "description": r["description"],
        "work_unit": numeric_or(r["weight"], 1.0),
        "raw_count": F.lit(1).cast("long"),
    }


def _digivol_reads(v: Column, item: Column, read: Read) -> dict[str, Column]:
    name_v = read("project.name")
    project = F.when(name_v.isNotNull(), F.when(variant_is_string(v, "project.name"), name_v)).otherwise(
        F.when(variant_is_string(v, "project"), read("project")))
    desc_path = F.coalesce(read("description"), read("subject"), read("task.name"))
    desc_is_str = (F.when(read("description").isNotNull(), variant_is_string(v, "description"))
                   .when(read("subject").isNotNull(), variant_is_string(v, "subject"))
                   .otherwise(variant_is_string(v, "task.name")))
    return {
        "ts": read("timestamp", "timestamp_utc", "created_at", "completed_at", "transcribed_at"),
        "guid": F.coalesce(read("guid", "id", "uuid"), F.sha2(item, 256)),
        "project": project,
        "description": F.when(desc_is_str, desc_path),
        "weight": F.coalesce(weight_value(item, read(*DIGIVOL_WEIGHT_PATHS)), F.lit("1")),
        "count": F.coalesce(read("raw_count", "rawCount"), F.lit("1")),
    }


def _digivol(r: Reads) -> dict[str, Column]:
    """Digivol feed; center is the source's name (or slug), never the payload."""
    return {
        "ts_text": r["ts"],
        "center": F.coalesce(truthy(F.col("source_name")), F.col("source_slug"), F.lit("")),
        "keep": ~blank(r["ts"]),
        "source_guid": r["guid"],
        "project": r["project"],
        "description": r["description"],
        "work_unit": numeric_or(r["weight"], 1.0),
        # floor stops at the largest long, where a cast would fail the job
        "raw_count": F.when(is_numeric(r["count"]), F.floor(F.trim(r["count"]).try_cast("double"))).otherwise(F.lit(1).cast("long")),
    }


def _generic_next(page: Column, page_offset: Column, kept: Column) -> Column:
    """The token the feed names, whatever it looks like."""
    token = variant_first(page, GENERIC_NEXT_TOKEN_PATHS)
    return F.when(~blank(token), token)


def _biospex_next(page: Column, page_offset: Column, kept: Column) -> Column:
    """The start of the next page while there is more to be found."""
    start, rows, found = (F.coalesce(variant_path(page, c).try_cast("long"), F.lit(d).cast("long"))
                          for c, d in (("start", 0), ("rows", FEED_PAGE_SIZE), ("numFound", 0)))
    return F.when(start + rows < found, (start + rows).cast("string"))


def _digivol_next(page: Column, page_offset: Column, kept: Column) -> Column:
    """The offset after the kept items of a full page."""
    return F.when(kept >= FEED_PAGE_SIZE, (page_offset * FEED_PAGE_SIZE + kept).cast("string"))


def _numbered(page: Column, page_offset: Column) -> Column:
    """A page that is asked for by its number."""
    return page_offset.cast("string")


def _biospex_own(page: Column, page_offset: Column) -> Column:
    """The start that the page was asked for with."""
    return F.coalesce(variant_path(page, "start"), (page_offset * FEED_PAGE_SIZE).cast("string"))


def _digivol_own(page: Column, page_offset: Column) -> Column:
    return (page_offset * FEED_PAGE_SIZE).cast("string")


class Adapter(NamedTuple):
    """The two steps of a family's mapping, and the paths that it reads."""

    paths: tuple[str, ...]
    reads: Callable[[Column, Column, Read], dict[str, Column]]  # of an item (VARIANT) and its JSON text
    fields: Callable[[Reads], dict[str, Column]]  # ``_FIELDS`` of what was read

    def __call__(self, v: Column, item: Column) -> dict[str, Column]:
        return self.fields(self.reads(v, item, lambda *paths: variant_first(v, paths)))


# Adapter family registry.
ADAPTERS: dict[str, Adapter] = {
    "generic": Adapter(("timestamp_utc", "timestamp", "center", "source_guid", "guid", "id", "project", "description", "raw_count",
                        "rawCount", *GENERIC_WEIGHT_PATHS), _generic_reads, _generic),
    "biospex": Adapter(("timestamp", "guid", "project", "description", *BIOSPEX_WEIGHT_PATHS), _biospex_reads, _biospex),
    "digivol": Adapter(("timestamp", "timestamp_utc", "created_at", "completed_at", "transcribed_at", "guid", "id", "uuid",
                        "project", "project.name", "description", "subject", "task.name", "raw_count", "rawCount",
                        *DIGIVOL_WEIGHT_PATHS), _digivol_reads, _digivol),
}


def item_texts(v: Column) -> Column:
    """The values of an item at the paths of every family, taken as literal keys, in one walk."""
    return variant_texts(v, sorted({p for adapter in ADAPTERS.values() for p in adapter.paths}))


def read_from(texts: Column, v: Column) -> Read:
    """N1 over ``item_texts``: first value over dotted paths, each as a literal key first, then the nested walk."""
    return lambda *paths: F.coalesce(*[c for p in paths for c in ((texts[p], variant_nested(v, p)) if "." in p else (texts[p],))])


# Family -> next-page token of a parsed page (VARIANT), its number and its count of kept items; null on the last page.
NEXT_TOKENS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "generic": _generic_next,
    "biospex": _biospex_next,
    "digivol": _digivol_next,
}
# Family -> the token that leads to a page, where the landed line does not keep it.
OWN_TOKENS: dict[str, Callable[[Column, Column], Column]] = {
    "generic": _numbered,
    "biospex": _biospex_own,
    "digivol": _digivol_own,
}


def register_adapter(family: str, types: tuple[str, ...], array_keys: tuple[str, ...],
                     mapping: Callable[[Column, Column], dict[str, Column]],
                     next_token: Callable[[Column, Column, Column], Column] = _generic_next,
                     own_token: Callable[[Column, Column], Column] = _numbered) -> None:
    """Make pages of further adapter types readable: every query, job and stream planned from then on maps them.

    ``mapping`` takes an item (VARIANT) and its JSON text and gives the columns ``_FIELDS``. A family registered again is
    replaced; a type that another family has is an error.
    """
    taken = {t for name, known in FAMILIES.items() if name != family for t in known.types} & set(types)
    if taken:
        raise ValueError(f"adapter types registered by another family: {sorted(taken)}")
    FAMILIES[family] = Family(tuple(types), tuple(array_keys))
    ADAPTERS[family] = Adapter((), lambda v, item, read: mapping(v, item), lambda r: {name: r[name] for name in _FIELDS})
    NEXT_TOKENS[family] = next_token
    OWN_TOKENS[family] = own_token


_FIELDS = ("ts_text", "center", "keep", "source_guid", "project", "description", "work_unit", "raw_count")


def map_items(items: DataFrame) -> DataFrame:
    """Every exploded item with its adapter's mapped fields and the F1 ``keep`` flag.

    ``items`` is ``explode_items`` output (items as VARIANT ``_v``) joined with
    the source columns ``source_name``, ``source_slug``, ``weight_field``.
    """
    specs = {fam: fn(F.col("_v"), F.col("item")) for fam, fn in ADAPTERS.items()}
    fam = F.col("_family")
    picked = []
    for field in _FIELDS:
        expr = None
        for name, spec in specs.items():
            expr = F.when(fam == name, spec[field]) if expr is None else expr.when(fam == name, spec[field])
        unknown = F.raise_error(F.concat(F.lit("unknown adapter type: "), F.coalesce(F.col("adapter_type"), F.lit("NULL"))))
        picked.append(expr.otherwise(unknown.cast("string") if field != "keep" else unknown.cast("boolean")).alias(field))
    return items.select("*", *picked).drop("_v")


def reject_items(items: DataFrame) -> DataFrame:
    """items dropped by their adapter's required-field rule, with the reason."""
    m = map_items(items).filter(~F.col("keep"))
    reason = (F.when(blank(F.col("ts_text")), F.lit("missing timestamp"))
              .when((F.col("_family") == "generic") & blank(F.col("center")), F.lit("missing center"))
              .when(F.col("_family") == "biospex", F.lit("missing guid"))
              .otherwise(F.lit("missing required field")))
    return m.select("event_id", "source_id", "page_offset", "item_pos", "_family", reason.alias("reason"), "item")


def reject_pages(pages: DataFrame) -> DataFrame:
    """pages that cannot be parsed, whole, in the columns of ``reject_items``; ``pages`` carry the adapter type."""
    return unreadable_pages(pages).select(
        "event_id", "source_id", "page_offset", F.lit(None).cast("int").alias("item_pos"),
        family_of(F.col("adapter_type")).alias("_family"), F.lit("unreadable page").alias("reason"), F.col("body").alias("item"))


def normalize_items(items: DataFrame, on_bad_ts: str = "fail") -> DataFrame:
    """N3-N5 + F1 + N7-N9: kept items as canonical records."""
    return records_from_mapped(map_items(items), on_bad_ts)


def records_from_mapped(mapped: DataFrame, on_bad_ts: str = "fail") -> DataFrame:
    """F1 + N7-N9 over ``map_items`` output: kept items as canonical records."""
    mapped = mapped.filter("keep")
    ts = parse_utc(F.col("ts_text"), on_bad=on_bad_ts)
    out = mapped.select(
        F.col("event_id").cast("long").alias("event_id"),
        F.col("source_id").cast("long").alias("source_id"),
        F.col("source_guid").cast("string").alias("source_guid"),
        F.col("center").cast("string").alias("center"),
        F.col("project").cast("string").alias("project"),
        F.col("description").cast("string").alias("description"),
        ts.alias("timestamp_utc"),
        bounded_work_unit(F.col("work_unit")).alias("work_unit"),
        bounded_raw_count(F.col("raw_count")).alias("raw_count"),
        F.col("item").alias("payload_json"),
        F.col("fetched_at").alias("created_at"),
        F.col("fetched_at").alias("updated_at"),
        # Last-wins order: fetch time, then page, then position on the page.
        ingest_order(at="fetched_at", page="page_offset", pos="item_pos").alias("ingest_seq"),
    )
    if on_bad_ts == "reject":
        out = out.filter(F.col("timestamp_utc").isNotNull())
    return out.withColumn("dedupe_key", dedupe_key())


def source_columns(sources: DataFrame) -> DataFrame:
    """The source fields the adapters read; a small dimension, broadcast."""
    return F.broadcast(sources.select("source_id", "adapter_type", F.col("name").alias("source_name"),
                                      F.col("slug").alias("source_slug"), "weight_field"))


def normalize_pages(pages: DataFrame, sources: DataFrame, on_bad_ts: str = "fail", types: tuple[str, ...] | None = None) -> DataFrame:
    """S1 -> N6 -> records: landed pages of every adapter type in one pass.

    With ``types``, those of sources of these adapter types only: the other pages are dropped before they are parsed.
    """
    if types is not None:
        sources = sources.filter(F.col("adapter_type").isin(*types))
    joined = pages.join(source_columns(sources), "source_id", "left" if types is None else "inner")
    return normalize_items(explode_items(joined), on_bad_ts=on_bad_ts)
