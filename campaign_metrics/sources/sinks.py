"""Chart documents and archived-chart snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaign_metrics.operators.running import running_positions
from campaign_metrics.schema import SNAPSHOT_MAX_AGE_SECONDS

PART_POINTS = 1000


def iso_hour(c) -> Column:
    """Bucket start as ISO-8601 with offset, as the chart API prints it."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def center_series_flat(meta: DataFrame, center_series: DataFrame) -> DataFrame:
    """S4 (flat): metadata columns next to every by-center point."""
    pts = center_series.select("event_id", "center", iso_hour(F.col("bucket")).alias("hour"), "weighted",
                               "cumulative_weighted", "raw", "cumulative_raw")
    return F.broadcast(meta).join(pts, "event_id")


def center_documents(meta: DataFrame, center_series: DataFrame) -> DataFrame:
    """S4 (nested): one document per campaign: meta + [{center, points[...]}].

    Points are gathered per (campaign, center) - one series, bounded by the
    campaign's bucket count - and sorted by hour; centers are sorted by name.
    """
    pts = center_series.select(
        "event_id", "center",
        F.struct(F.col("bucket").alias("t"), iso_hour(F.col("bucket")).alias("hour"), "weighted",
                 "cumulative_weighted", "raw", "cumulative_raw").alias("p"))
    per_center = pts.groupBy("event_id", "center").agg(
        F.transform(F.sort_array(F.collect_list("p")), lambda p: p.dropFields("t")).alias("points"))
    docs = per_center.groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("center", "points"))).alias("series"))
    m = meta.select("event_id", F.struct("event", "generated_at", "is_live", "metric_mode", "bucket_size").alias("meta"))
    return m.join(docs, "event_id", "left")


def _in_parts(rows: DataFrame, key: list[str], order: list[str], points: int) -> DataFrame:
    """``rows`` with ``part`` and ``place``: numbered in ``order`` within ``key`` and cut every ``points`` rows."""
    series = "_series"
    keyed = rows.withColumn(series, F.concat_ws("|", *[F.col(c).cast("string") for c in key]))
    numbered = running_positions(keyed, series, order, name="_n").drop(series)
    return numbered.withColumns({"part": F.floor((F.col("_n") - 1) / points), "place": (F.col("_n") - 1) % points}).drop("_n")


def center_document_parts(center_series: DataFrame, points: int = PART_POINTS) -> DataFrame:
    """S4 without a gather: a campaign's by-center document as numbered parts of at most ``points`` points.

    event_id, center, part (from 0), points (in order of hours). The parts of a center one after the other are its
    series, so a reader streams them and a writer holds one at a time; no group has more than ``points`` rows.
    """
    rows = center_series.select("event_id", "center", "bucket", iso_hour(F.col("bucket")).alias("hour"), "weighted",
                                "cumulative_weighted", "raw", "cumulative_raw")
    cut = _in_parts(rows, ["event_id", "center"], ["bucket"], points)
    point = F.struct("place", "hour", "weighted", "cumulative_weighted", "raw", "cumulative_raw")
    return cut.groupBy("event_id", "center", "part").agg(
        F.transform(F.sort_array(F.collect_list(point)), lambda p: p.dropFields("place")).alias("points"))


def snapshot_parts(campaigns: DataFrame, charts: dict[str, DataFrame], now: Column, points: int = PART_POINTS) -> DataFrame:
    """S5 without a gather: snapshots of the eligible campaigns as numbered parts of at most ``points`` chart rows.

    event_id, snapshot_type, part, data_json (a JSON array), generated_at. ``charts``: snapshot_type -> chart rows with
    event_id and bucket, and center where there is one.
    """
    eligible = snapshot_policy(campaigns)
    out = None
    for kind, rows in charts.items():
        order = [c for c in ("bucket", "center") if c in rows.columns]
        cut = _in_parts(rows.join(eligible, "event_id", "left_semi"), ["event_id"], order, points)
        fields = [c for c in rows.columns if c != "event_id"]
        part = cut.groupBy("event_id", "part").agg(F.to_json(F.transform(
            F.sort_array(F.collect_list(F.struct("place", *fields))), lambda p: p.dropFields("place"))).alias("data_json"))
        part = part.select("event_id", F.lit(kind).alias("snapshot_type"), "part", "data_json", now.alias("generated_at"))
        out = part if out is None else out.unionByName(part)
    return out


def write_chart(docs: DataFrame, path: str, fmt: str = "json") -> None:
    """Write chart documents, one folder per campaign."""
    docs.write.mode("overwrite").partitionBy("event_id").format(fmt).save(path)


def snapshot_policy(campaigns: DataFrame) -> DataFrame:
    """Charts of archived, not-live, public campaigns may be materialised."""
    return campaigns.filter(F.col("is_archived") & ~F.col("is_live") & F.col("is_public")).select("event_id")


def materialize_snapshots(existing: DataFrame, campaigns: DataFrame, charts: dict[str, DataFrame],
                          now: Column, max_age_seconds: int = SNAPSHOT_MAX_AGE_SECONDS) -> DataFrame:
    """The snapshot table after a refresh.

    ``existing``: (event_id, snapshot_type, data_json, generated_at);
    ``charts``: snapshot_type -> chart rows keyed by event_id. A snapshot of an
    eligible campaign younger than ``max_age_seconds`` is kept; older or
    missing ones are recomputed at ``now``; ineligible (live) campaigns are
    never stored. Keyed overwrite by (event_id, snapshot_type).
    """
    eligible = F.broadcast(snapshot_policy(campaigns))
    fresh_cut = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max_age_seconds))
    keep = (existing.join(eligible, "event_id", "left_semi")
            .filter(F.col("generated_at") > fresh_cut))
    parts = []
    for snap_type, rows in charts.items():
        cols = [c for c in rows.columns if c != "event_id"]
        data = (rows.join(eligible, "event_id", "left_semi")
                .groupBy("event_id")
                .agg(F.to_json(F.sort_array(F.collect_list(F.struct(*cols)))).alias("data_json"),
                     F.count(F.lit(1)).alias("points"))
                .withColumn("snapshot_type", F.lit(snap_type)))
        parts.append(data)
    recomputed = parts[0]
    for p in parts[1:]:
        recomputed = recomputed.unionByName(p)
    recomputed = recomputed.join(keep.select("event_id", "snapshot_type"), ["event_id", "snapshot_type"], "left_anti")
    out = keep.select("event_id", "snapshot_type", "data_json", "generated_at",
                      F.lit(None).cast("long").alias("points")).unionByName(
        recomputed.select("event_id", "snapshot_type", "data_json", now.alias("generated_at"), "points"))
    return out
