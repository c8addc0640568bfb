"""Landed pages as wholes (S1, N7, N9, R1): one verdict per page, its records, and the state that it leaves.

The reference stores a page's records in one statement, so a page with one bad value stores nothing, is marked as an
error, and the pages before it stay. Here a page is judged where it lies: its items are mapped inside the row, so the
verdict needs no shuffle and its items are read once. A page is quarantined, whole, for the first of these reasons:

* ``broken line``: the landed line is no row of the page schema (cut off, other types);
* ``unknown source`` / ``unknown adapter type``: nobody knows how to read it;
* ``repeated key``: its body is JSON with an object key given twice, which has no one meaning;
* ``unreadable body``: its body is no JSON, or over the size limit of a VARIANT;
* ``unparseable timestamp``, ``value out of range``: a kept item's time, weight (decimal(10,4)) or count (smallint)
  cannot be stored.

A null body is a page without items, and a good one, as is a page whose array is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaign_metrics.functions.json_paths import variant_is_object
from campaign_metrics.functions.keys import dedupe_key, ingest_order
from campaign_metrics.functions.time import parse_utc, ts_literal
from campaign_metrics.operators import adapters
from campaign_metrics.schema import ERROR_MESSAGE_LIMIT, RECORDS, WORK_UNIT
from campaign_metrics.sources.feeds import BROKEN_LINE, PAGE_TOKEN, family_of, page_items

PAGE = ["event_id", "source_id", "page_offset", "fetched_at"]
PAIR = ["event_id", "source_id"]
# Faults that name no source whose state could be kept.
UNASSIGNED = ("broken line", "unknown source")
_BEFORE_ALL = "1970-01-01 00:00:00"


def by_family(family: Column, of: Callable[[str], Column], dtype: str) -> Column:
    """``of(name)`` for the family of a row; null for a row of none."""
    out = F.lit(None).cast(dtype)
    for name in adapters.ADAPTERS:
        out = F.when(family == name, of(name)).otherwise(out)
    return out


def _read(x: Column, item: Column, family: Column) -> Column:
    """An item with what the family of its page reads of it, as one struct per family (null for the others)."""
    read = adapters.read_from(x["texts"], x["v"])
    return F.struct(
        x["pos"].alias("pos"), x["item"].alias("item"),
        *[F.when(family == name, F.struct(*[c.alias(k) for k, c in adapter.reads(x["v"], item, read).items()])).alias(name)
          for name, adapter in adapters.ADAPTERS.items()])


def _mapped(x: Column, family: Column) -> Column:
    """One item that was read (``_read``) as a struct of record fields; values that cannot be stored are null.

    A lambda shares no equal expressions: the fields are made of the values read, so that no path is read twice.
    """
    specs = {name: adapter.fields(x[name]) for name, adapter in adapters.ADAPTERS.items()}

    def pick(field: str, dtype: str) -> Column:
        return by_family(family, lambda name: specs[name][field].cast(dtype), dtype)

    return F.struct(
        x["pos"].alias("pos"), x["item"].alias("item"), pick("keep", "boolean").alias("keep"),
        parse_utc(pick("ts_text", "string"), on_bad="reject").alias("ts"),
        *[pick(c, "string").alias(c) for c in ("source_guid", "center", "project", "description")],
        F.round(pick("work_unit", "double"), 4).try_cast(WORK_UNIT).alias("work_unit"),
        F.greatest(F.lit(1).cast("long"), pick("raw_count", "long")).try_cast("short").alias("raw_count"))


def judge_pages(pages: DataFrame, sources: DataFrame, payload: bool = True) -> DataFrame:
    """Per landed page: its keys, ``family``, ``reason`` (null for a good page), ``items`` (the kept ones, mapped),
    ``items_read``, ``items_kept``, ``max_ts``, ``token`` (that leads to it; empty for the first page), ``next_token`` and,
    of a quarantined page, its text.

    ``pages`` have the columns of a landed page and may have ``broken_line`` and ``page_token``; the rest is ignored. Without
    ``payload`` the items are without their JSON text, which is then written only where a field is read from it.
    """
    known = adapters.source_columns(sources).withColumn("_known", F.lit(True))
    more = [F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in (BROKEN_LINE, PAGE_TOKEN)]
    family, body = F.col("family"), F.col("body")
    rows = (pages.select(*PAGE, "body", *more).join(known, "source_id", "left")
            .withColumns({"family": family_of(F.col("adapter_type")), "_page": F.try_parse_json("body")}))
    # An item is walked once for the values at its literal keys; they are null only if it is no object.
    walked = F.transform(page_items(F.col("_page"), family, strict=False), lambda v, i: F.struct(
        i.cast("long").alias("pos"), v.alias("v"), (F.to_json(v) if payload else F.lit(None).cast("string")).alias("item"),
        adapters.item_texts(v).alias("texts")))
    rows = rows.withColumn("_objects", F.filter(walked, lambda x: x["texts"].isNotNull()))
    read = F.transform("_objects", lambda x: _read(x, x["item"] if payload else F.to_json(x["v"]), family))
    kept = F.filter(F.transform(read, lambda x: _mapped(x, family)), lambda x: x["keep"])
    rows = rows.withColumn("_kept", kept)
    unread = body.isNotNull() & F.col("_page").isNull()
    reason = (F.when(F.col(BROKEN_LINE).isNotNull(), "broken line")
              .when(F.col("_known").isNull(), "unknown source")
              .when(family.isNull(), "unknown adapter type")
              .when(unread & F.get_json_object(body, "$").isNotNull(), "repeated key")
              .when(unread, "unreadable body")
              .when(F.exists("_kept", lambda x: x["ts"].isNull()), "unparseable timestamp")
              .when(F.exists("_kept", lambda x: x["work_unit"].isNull() | x["raw_count"].isNull()), "value out of range"))
    count = F.coalesce(F.size("_kept"), F.lit(0)).cast("long")
    token = by_family(family, lambda name: adapters.NEXT_TOKENS[name](F.col("_page"), F.col("page_offset"), count), "string")
    own = by_family(family, lambda name: adapters.OWN_TOKENS[name](F.col("_page"), F.col("page_offset")), "string")
    own = F.coalesce(F.col(PAGE_TOKEN), F.when(F.col("page_offset") == 0, ""), own)
    return rows.select(
        *PAGE, "family", reason.alias("reason"), F.col("_kept").alias("items"),
        F.greatest(F.coalesce(F.size("_objects"), F.lit(0)), F.lit(0)).cast("long").alias("items_read"), count.alias("items_kept"),
        F.array_max(F.transform("_kept", lambda x: x["ts"])).alias("max_ts"), own.alias("token"), token.alias("next_token"),
        F.when(reason.isNotNull(), F.coalesce(F.col(BROKEN_LINE), body)).alias("text"))


def good_records(judged: DataFrame) -> DataFrame:
    """Canonical records of the pages that are not quarantined."""
    r = F.col("r")
    rows = judged.select(*PAGE, F.explode(F.when(F.col("reason").isNull(), F.col("items"))).alias("r"))
    out = rows.select(
        F.col("event_id").cast("long").alias("event_id"), F.col("source_id").cast("long").alias("source_id"),
        *[r[c].alias(c) for c in ("source_guid", "center", "project", "description")], r["ts"].alias("timestamp_utc"),
        r["work_unit"].alias("work_unit"), r["raw_count"].alias("raw_count"), r["item"].alias("payload_json"),
        F.col("fetched_at").alias("created_at"), F.col("fetched_at").alias("updated_at"),
        ingest_order(at="fetched_at", page="page_offset", pos=r["pos"]).alias("ingest_seq"))
    return out.withColumn("dedupe_key", dedupe_key()).select(*[f.name for f in RECORDS.fields])


def quarantined_pages(judged: DataFrame) -> DataFrame:
    """Pages that were not ingested, with the reason and their text."""
    page = F.struct(*PAGE, "reason", "text")
    return judged.select(F.inline(F.when(F.col("reason").isNotNull(), F.array(page))))


def page_states(judged: DataFrame) -> DataFrame:
    """What the pages of a run leave per (campaign, source): event_id, source_id, pages_ok, max_ts, next_token, error.

    Every page counts, with records or without. The cursor and token are those of the good pages (the token that of the
    last fetched). A pair is in error if a bad page was fetched with or after its last good one; the message is that of the
    first bad page of the latest such fetch. One aggregate, combined map-side: a pair with a third of all pages is one row
    per task.
    """
    good = F.col("reason").isNull()
    at = F.coalesce(F.col("fetched_at"), ts_literal(_BEFORE_ALL))
    message = F.concat(F.col("reason"), F.lit(" on page "), F.coalesce(F.col("page_offset").cast("string"), F.lit("?")))
    page = F.coalesce(F.col("page_offset"), F.lit(-1).cast("long"))
    bad = ~good & ~F.col("reason").isin(*UNASSIGNED)
    states = (judged.groupBy(*PAIR).agg(
        F.count_if(good).alias("pages_ok"), F.max(F.when(good, F.col("max_ts"))).alias("max_ts"),
        F.max_by("next_token", F.when(good, F.struct(at, page))).alias("next_token"),
        F.max(F.when(good, at)).alias("_good"), F.max(F.when(bad, at)).alias("_bad"),
        F.max_by(message, F.when(bad, F.struct(at, -page))).alias("_message"))
        .filter(F.col("_good").isNotNull() | F.col("_bad").isNotNull()))
    failed = F.col("_bad").isNotNull() & (F.col("_good").isNull() | (F.col("_bad") >= F.col("_good")))
    return states.select(*PAIR, "pages_ok", "max_ts", "next_token", F.when(failed, F.col("_message")).alias("error"))


def advance_by_pages(checkpoints: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """M3 + A11 from page states: the cursor only rises, by good pages, whatever became of the others; a run without a
    good page leaves cursor and token; an error is kept until a run without one."""
    j = checkpoints.join(states, PAIR, "full_outer")
    ran = F.col("pages_ok").isNotNull()
    return j.select(
        *PAIR, F.greatest("last_seen_timestamp", "max_ts").alias("last_seen_timestamp"),
        F.when(F.col("pages_ok") > 0, F.col("next_token")).otherwise(F.col("last_page_token")).alias("last_page_token"),
        F.when(ran, now).otherwise(F.col("last_run_at")).alias("last_run_at"),
        F.when(ran & F.col("error").isNull(), "ok").when(ran, "error")
         .otherwise(F.coalesce(F.col("last_status"), F.lit("pending"))).alias("last_status"),
        F.when(ran, F.substring("error", 1, ERROR_MESSAGE_LIMIT)).otherwise(F.col("last_error")).alias("last_error"))
