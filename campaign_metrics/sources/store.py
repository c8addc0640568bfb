"""Canonical tables as Parquet datasets under one root (S3).

Records and the rollup are partitioned by campaign and UTC time slice (a day
by default, an hour for live ingest) and sorted inside each file by (center,
time): a campaign or date filter prunes folders, a center/time filter skips
row groups by their statistics. The dedupe key holds the record time, so a
re-sent record always lands in its original slice, and an upsert rewrites only
the (campaign, slice) folders holding re-sent keys. Files are written after a
range shuffle on (campaign, slice, center, time), so a campaign-slice holding a
third of all rows is still written by many balanced tasks.

Rewrites use dynamic partition overwrite. An upsert reads the partitions it
replaces, so its result is first written to a staging table in the shared
checkpoint folder, then copied over: a failed task never leaves a
half-overwritten source behind, and a retried job starts from intact inputs.

Dimensions (campaigns, sources, bridge, checkpoints) are replaced whole, each
time as a new version folder; readers take the newest one that was committed.
A write that dies leaves the version before it in force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaign_metrics.schema import CAMPAIGNS, CHECKPOINTS, EVENT_SOURCE, QUARANTINE, RECORDS, ROLLUP, SOURCES
from campaign_metrics.session import scratch_path

SCHEMAS = {
    "records": RECORDS, "rollup": ROLLUP, "campaigns": CAMPAIGNS, "sources": SOURCES,
    "bridge": EVENT_SOURCE, "checkpoints": CHECKPOINTS, "quarantine": QUARANTINE,
}
TIME_OF = {"records": "timestamp_utc", "rollup": "bucket_hour_utc"}
VERSIONED = ("campaigns", "sources", "bridge", "checkpoints")
SLICE = "time_slice"
PARTITION_COLS = ["event_id", SLICE]
SORT_WITHIN = {"records": ("center", "timestamp_utc"), "rollup": ("center", "bucket_hour_utc")}
SLICE_FORMATS = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd'T'HH"}


class Store:
    """A folder of canonical tables. ``slice`` is the time grain of the fact
    partitions: ``day`` (fewer, larger files; bulk imports) or ``hour``
    (a live campaign's re-sent keys rewrite one hour, not one day)."""

    def __init__(self, spark: SparkSession, root: str, slice: str = "day"):
        if slice not in SLICE_FORMATS:
            raise ValueError(f"slice must be one of {sorted(SLICE_FORMATS)}")
        self.spark = spark
        self.root = root.rstrip("/")
        self.slice = slice

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def slice_of(self, ts) -> Column:
        ts = F.col(ts) if isinstance(ts, str) else ts
        return F.date_format(ts, SLICE_FORMATS[self.slice])

    def touched(self, df: DataFrame, time_col: str = "timestamp_utc") -> DataFrame:
        """(campaign, slice) pairs a batch touches: bounded by campaigns x slices."""
        return df.select("event_id", self.slice_of(time_col).alias(SLICE)).distinct()

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self.path(name))
        return fs.exists(p)

    def _versions(self, name: str) -> list[int]:
        """Committed versions of a dimension, oldest first."""
        if not self.exists(name):
            return []
        fs, p = self._fs(self.path(name))
        folders = [s.getPath().getName() for s in fs.listStatus(p)]
        numbers = sorted(int(f.removeprefix("version=")) for f in folders if f.startswith("version="))
        return [n for n in numbers if fs.exists(self._fs(f"{self.path(name)}/version={n}/_SUCCESS")[1])]

    def _schema(self, name: str) -> T.StructType:
        schema = SCHEMAS[name]
        if name in TIME_OF:
            schema = T.StructType(list(schema.fields) + [T.StructField(SLICE, T.StringType())])
        return schema

    def _read_raw(self, name: str, path: str | None = None) -> DataFrame:
        return self.spark.read.schema(self._schema(name)).parquet(path or self.path(name))

    def read(self, name: str) -> DataFrame:
        """Read a table; an absent table reads as empty with its schema."""
        if name in VERSIONED:
            versions = self._versions(name)
            if not versions:
                return self.spark.createDataFrame([], SCHEMAS[name])
            return self._read_raw(name, f"{self.path(name)}/version={versions[-1]}")
        if not self.exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        df = self._read_raw(name)
        return df.drop(SLICE) if name in TIME_OF else df

    def read_partitions(self, name: str, touched: DataFrame) -> DataFrame:
        """Rows of the (campaign, slice) partitions in ``touched`` only; the semi
        join against the small touched set prunes folders at runtime (DPP)."""
        if not self.exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self._read_raw(name).join(touched, PARTITION_COLS, "left_semi").drop(SLICE)

    def in_partitions(self, df: DataFrame, parts: DataFrame, how: str, time_col: str = "timestamp_utc") -> DataFrame:
        """Rows of ``df`` inside (``left_semi``) or outside (``left_anti``) the given partitions."""
        keyed = df.withColumn(SLICE, self.slice_of(time_col))
        return keyed.join(parts, PARTITION_COLS, how).drop(SLICE)

    def _writer(self, df: DataFrame, name: str, shuffle: bool = True):
        if name in TIME_OF:
            keys = [*PARTITION_COLS, *SORT_WITHIN[name]]
            if shuffle:
                df = df.repartitionByRange(*keys)
            return df.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(*PARTITION_COLS)
        return df.write.mode("overwrite")

    def _with_slice(self, df: DataFrame, name: str) -> DataFrame:
        cols = [f.name for f in SCHEMAS[name].fields]
        df = df.select(*cols)
        return df.withColumn(SLICE, self.slice_of(TIME_OF[name])) if name in TIME_OF else df

    def write(self, name: str, df: DataFrame, touched_only: bool = True) -> None:
        """Replace a table (dimensions) or only the partitions present in ``df``.

        ``df`` may read this same table: a dimension is written as a new version
        beside the old one; facts are staged in the shared folder first, then
        the staged copy overwrites the touched partitions.
        """
        if name in VERSIONED:
            self._write_version(name, df)
            return
        staging = scratch_path(self.spark, f"stage-{name}")
        self._writer(self._with_slice(df, name), name).parquet(staging)
        staged = self._read_raw(name, staging) if name in TIME_OF else self.spark.read.schema(
            SCHEMAS[name]).parquet(staging)
        mode = "dynamic" if touched_only and name in TIME_OF else "static"
        prev = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        try:
            # Staged files are already laid out per partition: copy without a shuffle.
            self._writer(staged, name, shuffle=False).parquet(self.path(name))
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)
        fs, p = self._fs(staging)
        fs.delete(p, True)

    def _write_version(self, name: str, df: DataFrame) -> None:
        """A new version; the one before it stays for those who are reading it, older ones are removed."""
        versions = self._versions(name)
        new = versions[-1] + 1 if versions else 1
        self._with_slice(df, name).write.mode("overwrite").parquet(f"{self.path(name)}/version={new}")
        for old in versions[:-1]:
            self._remove(name, f"version={old}")

    def compact(self, name: str, max_files: int = 8) -> int:
        """Rewrite the (campaign, slice) partitions that hold more than ``max_files`` files (appends leave some each time);
        returns how many."""
        if not self.exists(name):
            return 0
        files = self._read_raw(name).select(*PARTITION_COLS, F.col("_metadata.file_path").alias("f")).distinct()
        many = self._stage(files.groupBy(*PARTITION_COLS).count().filter(F.col("count") > max_files).select(*PARTITION_COLS), "compact")
        n = many.count()
        if n:
            self.write(name, self.read_partitions(name, many))
        return n

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` to a fresh folder in the shared checkpoint dir and read it back
        (cuts lineage; later writes never read what they overwrite)."""
        path = scratch_path(self.spark, f"stage-{name}")
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to their (campaign, slice) partitions without rewriting existing files."""
        self._writer(self._with_slice(df, name), name).mode("append").parquet(self.path(name))

    def quarantine(self, pages: DataFrame, batch: int) -> None:
        """Keep the pages that a batch did not ingest; a batch that runs again replaces its own."""
        cols = [f.name for f in QUARANTINE.fields]
        (pages.withColumn("batch", F.lit(batch).cast("long")).select(*cols).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path("quarantine")))

    def apply_batch(self, incoming: DataFrame) -> None:
        """Incremental M1 + M2 for one ingest batch, with write cost bounded by the batch.

        New keys (the common case) are appended. Only (campaign, slice)
        partitions holding re-sent keys with other values are rewritten, merged
        so the first-seen ``created_at`` survives; a record that is stored as it
        comes again is neither shuffled nor written. The rollup of the touched
        partitions is then recomputed from the stored records, so a batch that
        died between the two writes converges when it is run again: appended
        keys are then re-sent keys with the same values, and their partitions
        are touched.
        """
        from campaign_metrics.operators.upsert import RECORD_COLUMNS, keep_last

        # The batch is written once and read back: every step reads only the columns it needs, by as many tasks as the size of
        # the batch asks for (a persisted batch stays in one small piece per shuffle partition, and each of them writes a
        # file per target whenever it is shuffled again).
        path = scratch_path(self.spark, "stage-batch")
        try:
            last = keep_last(incoming.select(*RECORD_COLUMNS))
            last.write.parquet(path)
            self._apply(self.spark.read.schema(last.schema).parquet(path))
        finally:
            fs, p = self._fs(path)
            fs.delete(p, True)

    def _apply(self, new: DataFrame) -> None:
        from campaign_metrics.operators.upsert import merge_records, record_digest

        # Keys alone tell whether a batch sends anything again; only then are the other columns read and digested.
        touched = self._stage(self.touched(new), "touched")
        stored = self.exists("records")
        if stored:
            held = self._read_raw("records").join(touched, PARTITION_COLS, "left_semi")
            again = self._stage(held.select("dedupe_key", *PARTITION_COLS).join(new.select("dedupe_key"), "dedupe_key"), "sent-again")
        if not stored or again.isEmpty():
            self.append("records", new)
        else:
            sent = new.select("dedupe_key", record_digest().alias("_sent"))
            held = (held.join(again.select(*PARTITION_COLS).distinct(), PARTITION_COLS, "left_semi")
                    .select("dedupe_key", *PARTITION_COLS, record_digest().alias("_held")))
            changed = self._stage(held.join(sent, "dedupe_key").filter(F.col("_held") != F.col("_sent"))
                                  .select(*PARTITION_COLS).distinct(), "changed")
            rest = new
            if not changed.isEmpty():
                self.write("records", merge_records(self.read_partitions("records", changed),
                                                    self.in_partitions(new, changed, "left_semi")))
                rest = self.in_partitions(new, changed, "left_anti")
            fresh = rest.join(again.select("dedupe_key"), "dedupe_key", "left_anti")
            self.append("records", fresh)
        self.refresh_rollup(touched)

    def _partitions(self, name: str) -> DataFrame:
        """The (campaign, slice) partitions that a table holds."""
        if not self.exists(name):
            return self.touched(self.spark.createDataFrame([], SCHEMAS[name]), TIME_OF[name])
        return self._read_raw(name).select(*PARTITION_COLS).distinct()

    def refresh_rollup(self, touched: DataFrame) -> None:
        """M2: recompute the rollup of the touched partitions from the stored records.

        Partitions of the same campaigns that hold records but no rollup are
        recomputed too, so a campaign is never left with a part of its rollup.
        """
        from campaign_metrics.operators.rollup import hourly_rollup

        lacking = (self._partitions("records").join(touched.select("event_id").distinct(), "event_id", "left_semi")
                   .join(self._partitions("rollup"), PARTITION_COLS, "left_anti"))
        stale = self._stage(touched.select(*PARTITION_COLS).unionByName(lacking.select(*PARTITION_COLS)).distinct(), "stale-slices")
        self.write("rollup", hourly_rollup(self.read_partitions("records", stale)).select(
            "event_id", "bucket_hour_utc", "center",
            F.col("weighted_sum").cast(ROLLUP["weighted_sum"].dataType).alias("weighted_sum"), "raw_sum"))

    def upsert_records(self, incoming: DataFrame) -> DataFrame:
        """M1 against the stored records of the touched (campaign, slice) partitions only."""
        from campaign_metrics.operators.upsert import upsert_records

        merged = upsert_records(self.read_partitions("records", self.touched(incoming)), incoming)
        self.write("records", merged)
        return merged

    def _remove(self, name: str, folder: str) -> None:
        """Remove one partition folder; nothing happens if it is gone already."""
        fs, p = self._fs(f"{self.path(name)}/{folder}")
        fs.delete(p, True)

    def delete(self, campaigns: DataFrame | None = None, sources: DataFrame | None = None) -> None:
        """Delete campaigns (event_id) and sources (source_id) with everything that hangs off them.

        A campaign's records and rollup are whole partitions, whose folders are removed without reading them. Of a source
        only the (campaign, slice) partitions that hold it are rewritten; those that hold nothing else are removed, and the
        rollup of all of them is recomputed. Children go first, the campaigns and sources themselves last. Every step gives
        the same result when it is run again, so a delete that died half way is run again with the same ids; ids that are
        not stored change nothing. The ids are a dimension's: the list of campaigns passes through the driver.
        """
        campaign_ids = [r.event_id for r in campaigns.select("event_id").distinct().collect()] if campaigns is not None else []
        for name in TIME_OF:
            for event_id in campaign_ids:
                self._remove(name, f"event_id={event_id}")
        if sources is not None and self.exists("records"):
            self._delete_source_records(sources.select("source_id").distinct())
        for name, keys in (("checkpoints", (campaigns, sources)), ("bridge", (campaigns, sources)), ("campaigns", (campaigns, None)),
                           ("sources", (None, sources))):
            left = self.read(name)
            for ids, key in zip(keys, ("event_id", "source_id")):
                if ids is not None:
                    left = left.join(ids.select(key).distinct(), key, "left_anti")
            if self._versions(name):
                self.write(name, left.select(*[f.name for f in SCHEMAS[name].fields]))

    def _delete_source_records(self, ids: DataFrame) -> None:
        from campaign_metrics.operators.rollup import hourly_rollup

        holding = self._stage(self._read_raw("records").join(ids, "source_id", "left_semi").select(*PARTITION_COLS).distinct(),
                              "holding-source")
        kept = self._stage(self.read_partitions("records", holding).join(ids, "source_id", "left_anti"), "without-source")
        if not kept.isEmpty():
            # the rollup first: as long as records of the source are stored, a second run finds their partitions again
            self.write("rollup", hourly_rollup(kept).select(
                "event_id", "bucket_hour_utc", "center",
                F.col("weighted_sum").cast(ROLLUP["weighted_sum"].dataType).alias("weighted_sum"), "raw_sum"))
            self.write("records", kept)
        for r in holding.join(self.touched(kept), PARTITION_COLS, "left_anti").collect():  # (campaign, slice) pairs left empty
            for name in reversed(TIME_OF):
                self._remove(name, f"event_id={r.event_id}/{SLICE}={r[SLICE]}")

    def rebuild_rollup(self, campaigns: DataFrame | None = None) -> None:
        """M2/A1 in bulk: recompute the rollup of the given campaigns (all when None)."""
        from campaign_metrics.operators.rollup import hourly_rollup

        recs = self.read("records")
        if campaigns is not None:
            recs = recs.join(F.broadcast(campaigns.select("event_id")), "event_id", "left_semi")
        self.write("rollup", hourly_rollup(recs).select(
            "event_id", "bucket_hour_utc", "center",
            F.col("weighted_sum").cast(ROLLUP["weighted_sum"].dataType).alias("weighted_sum"), "raw_sum"))
