"""Historical CSV exports.

Layout: ``<base>/<campaign dir>/newdata/<file>.csv`` when ``newdata`` exists,
else ``<base>/<campaign dir>/<file>.csv``; only ``ddf.csv`` and names ending
in ``Items.csv`` (case-sensitive) are imported. A "file" may also be a folder
of part files with that name, as Spark writes it.

Discovery lists directory names through the Hadoop FileSystem API (metadata
only, bounded by the number of files). Files are grouped by header line, and
each header shape is read by one ``spark.read.csv`` with a positional all-
string schema: the header decides the column names, so ``ID`` and ``id`` in
one header stay distinct without touching ``spark.sql.caseSensitive``.
"""

from __future__ import annotations

import csv
import io
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


HEADER_READERS = 16


@dataclass(frozen=True)
class CsvFile:
    campaign: str   # campaign directory name
    path: str       # file (or part-file folder) path
    name: str       # base name, e.g. ddf.csv


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _list(spark: SparkSession, path: str):
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [(st.getPath().getName(), st.getPath().toString(), st.isDirectory()) for st in fs.listStatus(p)]


def importable(name: str) -> bool:
    return name == "ddf.csv" or name.endswith("Items.csv")


def discover_csv_files(spark: SparkSession, base: str, campaign: str | None = None) -> list[CsvFile]:
    """Campaign directories (sorted) and their importable files (sorted).

    Directories without an importable file are skipped; an empty result or a
    missing requested campaign is an error, as in the reference.
    """
    fs, bp = _fs(spark, base)
    if not fs.exists(bp):
        raise FileNotFoundError(f"historical import path not found: {base}")
    entries = [(n, p) for n, p, is_dir in _list(spark, base) if is_dir]
    if campaign is not None:
        entries = [(n, p) for n, p in entries if n == campaign]
        if not entries:
            raise FileNotFoundError(f"historical campaign directory not found: {base}/{campaign}")
    out: list[CsvFile] = []
    for name, path in sorted(entries):
        children = _list(spark, path)
        newdata = [p for n, p, d in children if d and n == "newdata"]
        pool = _list(spark, newdata[0]) if newdata else children
        files = sorted((n, p) for n, p, _ in pool if n.endswith(".csv") and importable(n))
        out.extend(CsvFile(name, p, n) for n, p in files)
    if not out:
        raise FileNotFoundError(f"no historical campaign directories found in {base}")
    return out


def _first_data_file(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.getFileStatus(p).isDirectory():
        return path
    parts = sorted(pp for n, pp, d in _list(spark, path) if not d and not n.startswith(("_", ".")))
    return parts[0] if parts else None


def read_header(spark: SparkSession, path: str) -> tuple[str, ...] | None:
    """The header row of a CSV file (or of the first part file of a folder)."""
    data = _first_data_file(spark, path)
    if data is None:
        return None
    fs, p = _fs(spark, data)
    stream = fs.open(p)
    try:
        jvm = spark.sparkContext._jvm
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
    finally:
        stream.close()
    if line is None:
        return None
    return tuple(next(csv.reader(io.StringIO(line.lstrip("﻿")))))


def files_with_open_quotes(spark: SparkSession, paths: list[str]) -> set[str]:
    """Physical files that hold a line with an odd number of quotes: a quoted newline, or a stray quote.

    One scan of the lines; what comes back are file names.
    """
    lines = spark.read.text(paths)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return {r.f for r in lines.filter(quotes % 2 == 1).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}


def read_shapes(spark: SparkSession, files: list[CsvFile], multiline: bool = True
                ) -> list[tuple[tuple[str, ...], DataFrame]]:
    """One DataFrame per header shape: positional string columns ``_c0..``
    plus ``campaign_dir``, ``file_name``, ``file_path``, ``file_order`` (position
    in discovery order), ``block_start`` (where the read split starts) and
    ``row_order`` (position inside the split).

    ``multiline`` honours quoted newlines, and makes each file one split. Switched
    off for large exports, the lines are scanned for open quotes first: files
    that have some are read whole all the same, the others in many splits.
    """
    by_header: dict[tuple[str, ...], list[tuple[int, CsvFile]]] = {}
    with ThreadPoolExecutor(HEADER_READERS) as pool:  # one line of each file, many files at a time
        headers = list(pool.map(lambda f: read_header(spark, f.path), files))
    for order, (f, h) in enumerate(zip(files, headers)):
        if h is not None:
            by_header.setdefault(h, []).append((order, f))
    open_files = set() if multiline else {_logical_name(f) for f in files_with_open_quotes(spark, [f.path for f in files])}
    shapes = []
    for header, group in by_header.items():
        whole = [(o, g) for o, g in group if multiline or _logical_name(g.path) in open_files]
        split = [(o, g) for o, g in group if (o, g) not in whole]
        parts = [_read_shape(spark, header, some, lines) for some, lines in ((whole, True), (split, False)) if some]
        shapes.append((header, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])))
    return shapes


def _logical_name(path: str) -> str:
    """A CSV file's path without scheme; a part file stands for its folder."""
    path = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", path)
    parent = path.rsplit("/", 1)[0]
    return parent if parent.endswith(".csv") else path


def _read_shape(spark: SparkSession, header: tuple[str, ...], group: list[tuple[int, CsvFile]], multiline: bool) -> DataFrame:
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(header))])
    df = (spark.read.schema(schema).option("header", True).option("multiLine", multiline)
          .option("escape", '"').option("mode", "PERMISSIVE").csv([g.path for _, g in group]))
    # Row position inside its read split: rows of one file come in file order,
    # so (file_order, path, block_start, row_order) orders every row (last wins).
    df = df.withColumn("row_order", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    path_col = F.col("_metadata.file_path")
    # Map each physical file back to its logical (campaign, name) and sorted position.
    lookup = spark.createDataFrame([(g.campaign, g.name, g.path, o) for o, g in group],
                                   "campaign_dir string, file_name string, logical_path string, file_order long")
    parent = F.regexp_extract(path_col, r"^(.*)/[^/]+$", 1)
    logical = F.when(parent.endswith(".csv"), parent).otherwise(path_col)
    df = df.withColumn("file_path", path_col).withColumn("logical_path", logical)
    df = df.withColumn("block_start", F.col("_metadata.file_block_start"))
    return df.join(lookup, "logical_path").drop("logical_path")


def write_csv_tree(df: DataFrame, base: str, dir_col: str, file_col: str, newdata_dirs: set[str],
                   columns: dict[str, list[str]]) -> None:
    """Write ``df`` as a campaign CSV tree: one Spark write per file name (its
    own header), partitioned by campaign directory, then each partition folder
    is renamed to ``<base>/<dir>[/newdata]/<file name>`` (a folder of parts).

    ``columns`` maps a file name to its header; the values come from ``df``
    columns ``_0``, ``_1``, ... in header order.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file_name, cols in columns.items():
        staging = f"{base}.staging/{file_name.replace('.', '_')}"
        part = df.filter(F.col(file_col) == file_name).select(
            dir_col, *[F.col(f"`_{i}`").alias(c) for i, c in enumerate(cols)])
        # A header may hold names differing only in case (ID, id).
        prev = spark.conf.get("spark.sql.caseSensitive")
        spark.conf.set("spark.sql.caseSensitive", "true")
        try:
            (part.write.mode("overwrite").partitionBy(dir_col).option("header", True).option("escape", '"')
             .csv(staging))
        finally:
            spark.conf.set("spark.sql.caseSensitive", prev)
        for name, path, is_dir in _list(spark, staging):
            if not is_dir or not name.startswith(f"{dir_col}="):
                continue
            d = name.split("=", 1)[1]
            target_dir = f"{base}/{d}/newdata" if d in newdata_dirs else f"{base}/{d}"
            fs, tp = _fs(spark, target_dir)
            fs.mkdirs(tp)
            fs.rename(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{target_dir}/{file_name}"))
