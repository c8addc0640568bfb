"""Column expressions: numeric guards, blanks, slugs, labels, time parsing, keys, zones."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from campaign_metrics.functions import keys, text, time
from campaign_metrics.operators.adapters import php_float, php_int
from tests.conftest import ts


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_numeric_guard(spark):
    cases = {"1e3": True, "NaN": False, "5d": False, " 2.5 ": True, ".5": True, "-3": True, "": False,
             "0x1A": False, "1,5": False}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.ok for r in df.select("s", text.is_numeric(F.col("s")).alias("ok")).collect()}
    assert got == cases


def test_filled_and_first_numeric(spark):
    df = spark.createDataFrame([("NA", " na ", "  ", "7", "x")], "a string, b string, c string, d string, e string")
    row = df.select(text.filled("a").alias("a"), text.filled("b").alias("b"), text.filled("c").alias("c"),
                    text.first_filled(["a", "b", "c", "d"]).alias("first"),
                    text.first_numeric(["e", "d"], 1.0).alias("num"),
                    text.first_numeric(["a", "d"], 1.0).alias("num2")).first()
    assert (row.a, row.b, row.c, row.first) == (None, None, None, "7")
    assert row.num == 1.0     # first filled value 'x' is not numeric: default, 'd' is not tried
    assert row.num2 == 7.0    # 'NA' is missing, so the next alias is read


def test_php_casts(spark):
    df = spark.createDataFrame([("abc",), ("12abc",), (None,), ("2.7",), ("-2.7",), ("1e2",)], "s string")
    got = [(r.f, r.i) for r in df.select(php_float(F.col("s"), 1.0).alias("f"),
                                         php_int(F.col("s"), 1).alias("i")).collect()]
    assert got == [(0.0, 0), (12.0, 12), (1.0, 1), (2.7, 2), (-2.7, -2), (100.0, 100)]


def test_slugs_labels_and_display_names(spark):
    assert _one(spark, text.canonical_slug(F.lit(2020), F.lit("fall"))) == "campaign-2020-fall"
    assert _one(spark, text.canonical_slug(F.lit(2020), F.lit(None).cast("string"))) == "campaign-2020"
    assert _one(spark, text.canonical_slug(F.lit(2021), F.lit("spring"), prefix="My Brand")) == "my-brand-2021-spring"
    assert _one(spark, text.display_name(F.lit(" Lite "), F.lit("x"), F.lit(2020), F.lit("spring"))) == "Lite"
    assert _one(spark, text.display_name(F.lit(None).cast("string"), F.lit("campaign-2020-fall"), F.lit(2020),
                                         F.lit("fall"))) == "Campaign 2020 Fall"
    assert _one(spark, text.display_name(F.lit(""), F.lit(None).cast("string"), F.lit(2019),
                                         F.lit("spring"))) == "Campaign 2019 Spring"
    assert _one(spark, text.season_label(F.lit(2019), F.lit("fall"))) == "2019 Fall"
    assert _one(spark, text.season_label(F.lit(2019), F.lit(" "))) == "2019"
    assert text.normalize_header(" Discretionary State.WorkUnit ") == "discretionary_state_workunit"


def test_timestamp_parsing(spark):
    df = spark.createDataFrame([("2026-03-09T03:36:12.123456Z",), ("2026-03-09T05:36:12+02:00",),
                                ("2026-03-09 03:36:12",), ("junk",), ("",)], "s string")
    got = [r.t for r in df.select(time.parse_utc(F.col("s")).alias("t")).collect()]
    assert got == [ts("2026-03-09 03:36:12.123456"), ts("2026-03-09 03:36:12"), ts("2026-03-09 03:36:12"), None, None]
    bad = spark.createDataFrame([("junk",)], "s string")
    with pytest.raises(Exception):
        bad.select(time.parse_utc(F.col("s"), on_bad="fail")).collect()
    assert _one(spark, time.iso_seconds(time.ts_literal("2026-03-09 03:36:12.9"))) == "2026-03-09T03:36:12+00:00"


def test_dedupe_key_matches_sha256(spark):
    df = spark.createDataFrame([(1, 2, "g", ts("2026-03-09 03:36:12"), "C", None)],
                               "event_id long, source_id long, source_guid string, timestamp_utc timestamp_ntz,"
                               " center string, project string")
    got = df.select(keys.dedupe_key()).first()[0]
    assert got == hashlib.sha256(b"1|2|g|2026-03-09T03:36:12+00:00|C|").hexdigest()


def test_bounds_and_zones(spark):
    assert _one(spark, keys.bounded_raw_count(F.lit(0))) == 1
    assert str(_one(spark, keys.bounded_work_unit(F.lit(1.23456)))) == "1.2346"
    tonga = _one(spark, time.wall_to_utc(time.ts_literal("2024-01-10 12:00:00"), "Pacific/Tongatapu"))
    assert tonga == ts("2024-01-09 23:00:00")
    ny = _one(spark, time.utc_to_wall(time.ts_literal("2024-01-10 12:00:00"), "America/New_York"))
    assert ny == ts("2024-01-10 07:00:00")
    assert _one(spark, time.minutes_until(time.ts_literal("2024-01-10 12:00:00"),
                                          time.ts_literal("2024-01-10 14:25:30"))) == 145


def test_white_space_of_every_kind_is_blank(spark):
    df = spark.createDataFrame([(" \t\n",), ("NA\t",), ("\x0b x\r\n",), ("\0",)], "v string")
    got = [(r.b, r.f) for r in df.select(text.blank("v").alias("b"), text.filled("v").alias("f")).collect()]
    assert got[0][0] and got[3][0] and not got[2][0]
    assert [f or None for _, f in got] == [None, None, "x", None]


def test_long_season_label_is_whole(spark):
    r = spark.range(1).select(text.season_label(F.lit(2024), F.lit("s" * 20_000)).alias("l")).first()
    assert r.l == "2024 S" + "s" * 19_999
