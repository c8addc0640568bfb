"""Chart series for all campaigns at once.

Every function takes whole DataFrames and returns one; the per-campaign
choices (live or not, minute or hour buckets, rollup or raw) are columns of
the broadcast campaign dimension, never a driver-side branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campaign_metrics.functions.time import bucket, bucket_size, chart_time, floor_to
from campaign_metrics.operators.rollup import hourly_rollup
from campaign_metrics.operators.running import running_sums, running_sums_small


def campaign_plan(campaigns: DataFrame, now: Column, public_only: bool = True) -> DataFrame:
    """Per campaign: W8 bucket size and the W9 time axis flag (a small dimension)."""
    c = campaigns.filter("is_public") if public_only else campaigns
    return c.select("event_id", "slug", "is_live", "starts_at",
                    bucket_size(F.col("is_live"), F.col("starts_at"), now).alias("bucket_size"))


def _bucketed_records(records: DataFrame, plan: DataFrame) -> DataFrame:
    """Records of planned campaigns with their chart time and bucket start."""
    r = records.select("event_id", "center", "timestamp_utc", "created_at", "work_unit", "raw_count")
    j = r.join(F.broadcast(plan.select("event_id", "is_live", "bucket_size")), "event_id")
    t = chart_time(F.col("is_live"))
    return j.select("event_id", "center", "work_unit", "raw_count",
                    bucket(F.col("bucket_size"), t).alias("bucket"))


def _raw_by_center(records: DataFrame, plan: DataFrame) -> DataFrame:
    return (_bucketed_records(records, plan)
            .groupBy("event_id", "center", "bucket")
            .agg(F.sum("work_unit").alias("weighted"), F.sum(F.col("raw_count").cast("long")).alias("raw")))


def activity_by_center(records: DataFrame, rollup: DataFrame, campaigns: DataFrame, now: Column) -> DataFrame:
    """A3: per public campaign, center and bucket: weighted and raw sums.

    Live campaigns read the records (W8 buckets on the W9 axis). Others read
    the rollup, falling back to the records (hour buckets on activity time)
    when the rollup has no rows for them (A12).
    """
    plan = F.broadcast(campaign_plan(campaigns, now))
    live = plan.filter("is_live")
    settled = plan.filter("NOT is_live")
    from_rollup = (rollup.join(F.broadcast(settled.select("event_id")), "event_id", "left_semi")
                   .select("event_id", "center", F.col("bucket_hour_utc").alias("bucket"),
                           F.col("weighted_sum").alias("weighted"), F.col("raw_sum").alias("raw")))
    have = rollup.select("event_id").distinct()
    need_raw = live.unionByName(settled.join(F.broadcast(have), "event_id", "left_anti"))
    from_raw = _raw_by_center(records, need_raw)
    return from_rollup.unionByName(from_raw)


def activity_per_bucket(records: DataFrame, rollup: DataFrame, campaigns: DataFrame, now: Column) -> DataFrame:
    """A2: per public campaign and bucket, summed over centers (the rollup
    re-aggregated, or the records directly)."""
    by_center = activity_by_center(records, rollup, campaigns, now)
    return (by_center.groupBy("event_id", "bucket")
            .agg(F.sum("weighted").alias("weighted"), F.sum("raw").alias("raw")))


def campaign_summary(records: DataFrame, campaigns: DataFrame, public_only: bool = True) -> DataFrame:
    """A4: totals per campaign; campaigns without records get zeros and NULL times."""
    c = campaigns.filter("is_public") if public_only else campaigns
    dims = F.broadcast(c.select("event_id", "is_live"))
    r = records.select("event_id", "center", "timestamp_utc", "created_at", "work_unit", "raw_count")
    t = chart_time(F.col("is_live"))
    agg = (r.join(dims, "event_id")
           .groupBy("event_id")
           .agg(F.sum("work_unit").alias("weighted_total"),
                F.sum(F.col("raw_count").cast("long")).alias("raw_total"),
                F.count_distinct("center").alias("center_count"),
                F.min(t).alias("first_timestamp"),
                F.max(t).alias("latest_timestamp")))
    return (c.select("event_id").join(agg, "event_id", "left")
            .select("event_id",
                    F.coalesce("weighted_total", F.lit(0).cast("decimal(20,4)")).alias("weighted_total"),
                    F.coalesce("raw_total", F.lit(0).cast("long")).alias("raw_total"),
                    F.coalesce("center_count", F.lit(0).cast("long")).alias("center_count"),
                    "first_timestamp", "latest_timestamp"))


def record_running_totals(records: DataFrame, campaigns: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Every record of a public campaign in chart-time order with running
    weighted and raw totals. Ties on time are broken by the dedupe key.

    Uses the range-partitioned running sum, so one huge campaign is spread
    over many tasks.
    """
    dims = F.broadcast(campaigns.filter("is_public").select("event_id", "is_live"))
    r = (records.select("event_id", "dedupe_key", "timestamp_utc", "created_at", "work_unit", "raw_count")
         .join(dims, "event_id")
         .select("event_id", "dedupe_key", chart_time(F.col("is_live")).alias("chart_ts"),
                 F.col("work_unit").alias("weighted"), F.col("raw_count").cast("long").alias("raw")))
    return running_sums(r, "event_id", ["chart_ts", "dedupe_key"], {"weighted": 4, "raw": 0},
                        num_partitions=num_partitions)


def center_running_totals(by_center: DataFrame) -> DataFrame:
    """Running totals per (campaign, center) over buckets; each point keeps
    its own value. The input is already aggregated to buckets."""
    return running_sums_small(by_center, ["event_id", "center"], ["bucket"], ["weighted", "raw"])


def series_running_total(per_bucket: DataFrame) -> DataFrame:
    """Running total of the campaign bucket series."""
    return running_sums_small(per_bucket, ["event_id"], ["bucket"], ["weighted", "raw"])


def pad_single_points(series: DataFrame, keys: list[str], zero_cols: list[str], time_col: str = "bucket") -> DataFrame:
    """A series of exactly one point gains a zero point one hour earlier."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    marked = series.withColumn("_n", n)
    single = marked.filter("_n = 1")
    pad = single.select(*[
        (F.col(time_col) - F.make_dt_interval(F.lit(0), F.lit(1), F.lit(0), F.lit(0))).alias(c) if c == time_col
        else (F.lit(0).cast(series.schema[c].dataType).alias(c) if c in zero_cols else F.col(c))
        for c in series.columns])
    return marked.drop("_n").unionByName(pad)


def center_hour_matrix(center_series: DataFrame, value: str = "cumulative_weighted") -> DataFrame:
    """W5 (wide form): one row per campaign and hour over the union of all
    hours (U1), one column per center; a center without a point at that hour
    is NULL (not forward-filled). Spark's pivot finds the center list itself."""
    return (center_series.groupBy("event_id", "bucket").pivot("center").agg(F.first(value)))


def center_hour_grid(center_series: DataFrame, value: str = "cumulative_weighted") -> DataFrame:
    """W5 (long form): a row for every hour and center of a campaign, null where the center has no point at that hour.

    The grid is each campaign's distinct hours joined to its distinct centers, so it has no limit on centers and no row
    that the matrix would not have as a cell; the series meets it by its whole key.
    """
    hours = center_series.select("event_id", "bucket").distinct()
    centers = center_series.select("event_id", "center").distinct()
    points = center_series.groupBy("event_id", "bucket", "center").agg(F.max(value).alias(value))
    return hours.join(centers, "event_id").join(points, ["event_id", "bucket", "center"], "left").select(
        "event_id", "bucket", "center", value)


def chart_meta(campaigns: DataFrame, now: Column) -> DataFrame:
    """S4 metadata per public campaign."""
    plan = campaign_plan(campaigns, now)
    return plan.select("event_id", F.col("slug").alias("event"), now.alias("generated_at"), "is_live",
                       F.lit("weighted").alias("metric_mode"), "bucket_size")


__all__ = ["activity_by_center", "activity_per_bucket", "campaign_summary", "record_running_totals",
           "center_running_totals", "series_running_total", "pad_single_points", "center_hour_matrix", "center_hour_grid",
           "chart_meta", "campaign_plan", "hourly_rollup", "floor_to"]
