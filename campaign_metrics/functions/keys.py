"""Record identity and canonical bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from campaign_metrics.functions.time import iso_seconds
from campaign_metrics.schema import INGEST_ORDER, WORK_UNIT


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dedupe_key(event_id="event_id", source_id="source_id", guid="source_guid",
               ts="timestamp_utc", center="center", project="project") -> Column:
    """sha256 of event|source|guid|ISO time|center|project-or-empty.

    ``concat_ws`` skips NULLs, so the project is coalesced to '' to keep the
    separator count fixed.
    """
    return F.sha2(F.concat_ws("|", _col(event_id).cast("string"), _col(source_id).cast("string"),
                              _col(guid).cast("string"), iso_seconds(ts), _col(center),
                              F.coalesce(_col(project), F.lit(""))), 256)


def bounded_work_unit(c) -> Column:
    """Weight rounded to 4 places (decimal(10,4) at rest)."""
    return F.round(_col(c).cast("double"), 4).cast(WORK_UNIT)


def bounded_raw_count(c) -> Column:
    """Count raised to at least 1."""
    return F.greatest(F.lit(1), _col(c).cast("long")).cast("short")


def ingest_order(**parts) -> Column:
    """The order of record versions as a struct (see ``INGEST_ORDER``); parts not given are NULL."""
    return F.struct(*[_col(parts[f.name]).cast(f.dataType).alias(f.name) if f.name in parts
                      else F.lit(None).cast(f.dataType).alias(f.name) for f in INGEST_ORDER.fields])
