"""Landed feed pages.

A poller lands every fetched page as one JSON Lines row
``(event_id, source_id, page_offset, fetched_at, body)``; Spark reads them with
an explicit schema (batch or ``readStream``) and unnests the record array. A line
that is no such row (cut off, or of other types) comes back whole in the column
``broken_line``; its other columns are null, but for those of the folder and
those that could be read. A line may hold ``page_token``, the token that the page was asked for with (null on the
first page and where pages are numbered).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaign_metrics.functions.json_paths import variant_array_items, variant_is_object
from campaign_metrics.schema import ADAPTER_BIOSPEX, ADAPTER_DIGIVOL, ADAPTER_GENERIC, FEED_ARRAY_KEYS, LANDED_PAGE

BROKEN_LINE, PAGE_TOKEN = "broken_line", "page_token"
LANDED_LINE = T.StructType([*LANDED_PAGE.fields, T.StructField(PAGE_TOKEN, T.StringType()), T.StructField(BROKEN_LINE, T.StringType())])


class Family(NamedTuple):
    """What the adapter types of one feed family share on the page level."""

    types: tuple[str, ...]
    array_keys: tuple[str, ...]  # keys that may hold the records, in the order they are tried


# Feed families by name; ``adapters.register_adapter`` adds to them.
FAMILIES: dict[str, Family] = {
    "generic": Family(ADAPTER_GENERIC, FEED_ARRAY_KEYS["generic"]),
    "biospex": Family((ADAPTER_BIOSPEX,), FEED_ARRAY_KEYS["biospex"]),
    "digivol": Family((ADAPTER_DIGIVOL,), FEED_ARRAY_KEYS["digivol"]),
}


def read_feed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of landed pages (JSON Lines, explicit schema: no inference pass)."""
    return spark.read.schema(LANDED_LINE).option("columnNameOfCorruptRecord", BROKEN_LINE).json(path)


def stream_feed_pages(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of landed pages, with the same columns."""
    reader = spark.readStream.schema(LANDED_LINE).option("columnNameOfCorruptRecord", BROKEN_LINE).format("json")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def write_feed_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Land pages as JSON Lines, one folder per campaign."""
    cols = [f.name for f in LANDED_PAGE.fields] + [c for c in (PAGE_TOKEN,) if c in pages.columns]
    pages.select(*cols).write.mode(mode).partitionBy("event_id").json(path)


def family_of(adapter_type) -> F.Column:
    """Adapter type -> feed family (which array keys, which mapping); null for a type that is not registered."""
    out = F.lit(None).cast("string")
    for name, family in FAMILIES.items():
        out = F.when(adapter_type.isin(*family.types), F.lit(name)).otherwise(out)
    return out


def page_items(page, family, strict: bool = True) -> F.Column:
    """Items of a parsed page (VARIANT): the family's first key holding an array.

    A page of no registered family raises, or has no items if not ``strict``.
    """
    out = F.raise_error(F.lit("unknown adapter type for a landed page")) if strict else F.lit(None)
    out = out.cast("array<variant>")
    for name, known in FAMILIES.items():
        out = F.when(family == name, variant_array_items(page, known.array_keys)).otherwise(out)
    return out


def explode_items(pages: DataFrame, adapter_type_col: str = "adapter_type") -> DataFrame:
    """One row per object item, with its position on the page.

    The page body is parsed once (VARIANT); items stay VARIANT (``_v``), so
    field reads never re-parse text, even where the optimizer pushes a filter
    below the projection. ``item`` is the item's canonical JSON text.
    Non-object items are skipped; a page without an array yields no rows, nor
    does one that cannot be parsed (``unreadable_pages``).
    ``pages`` must carry the adapter type (join the source dimension first).
    """
    fam = family_of(F.col(adapter_type_col))
    parsed = pages.withColumn("_family", fam).withColumn("_page", F.try_parse_json(F.col("body")))
    with_items = parsed.withColumn("_items", page_items(F.col("_page"), F.col("_family")))
    keep = [c for c in pages.columns if c != "body"]
    exploded = with_items.select(*keep, "_family", F.posexplode("_items").alias("item_pos", "_v"))
    return (exploded.filter(variant_is_object(F.col("_v")))
            .withColumn("item", F.to_json(F.col("_v"))))


def unreadable_pages(pages: DataFrame) -> DataFrame:
    """Pages whose body is not one JSON value that VARIANT holds: malformed, with a
    repeated key, or over its size limit. ``explode_items`` has no rows of them."""
    return pages.filter(F.col("body").isNotNull() & F.try_parse_json(F.col("body")).isNull())
