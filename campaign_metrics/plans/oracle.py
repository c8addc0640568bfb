"""DuckDB SQL for every registered query (the independent correctness oracle).

The bindings of ``sources.bindings`` are restated here as CTEs over the
driver's views, then each query is written plainly in SQL. Output columns
carry the same names and types as the Spark side (DOUBLE for sums, BIGINT for
integers, TIMESTAMP for instants).
"""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-21 00:30:00'"

# name -> (sql, dependencies). Order of definition = order of emission.
CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (sql, deps)


cte("base", """
  SELECT event_id AS src_id, ts, user_id, event_type, value, props,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(user_id % 5 AS BIGINT) AS event_id,
         CAST(user_id % 25 AS BIGINT) AS source_id
  FROM events""")

cte("records", """
  SELECT event_id, source_id, CAST(src_id AS VARCHAR) AS source_guid, event_type AS center,
         CASE WHEN k % 10 <> 0 THEN 'p' || CAST(k % 7 AS VARCHAR) END AS project,
         CAST(NULL AS VARCHAR) AS description,
         ts AS timestamp_utc,
         CAST(value / 10 AS DECIMAL(10,4)) AS work_unit,
         CAST(1 + k % 3 AS SMALLINT) AS raw_count,
         props AS payload_json,
         ts + to_seconds(CAST(src_id % 90 AS BIGINT)) AS created_at,
         src_id AS ingest_seq,
         sha256(concat_ws('|', CAST(event_id AS VARCHAR), CAST(source_id AS VARCHAR), CAST(src_id AS VARCHAR),
                strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00'), event_type,
                COALESCE(CASE WHEN k % 10 <> 0 THEN 'p' || CAST(k % 7 AS VARCHAR) END, ''))) AS dedupe_key
  FROM base""", "base")

cte("records_large", """
  SELECT CAST(year(l.l_shipdate) % 5 AS BIGINT) AS event_id,
         CAST(s.s_nationkey AS BIGINT) AS source_id,
         concat_ws('-', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR), CAST(l.l_partkey AS VARCHAR), CAST(l.l_suppkey AS VARCHAR)) AS source_guid,
         n.n_name AS center,
         CAST(NULL AS VARCHAR) AS project,
         l.l_shipdate + to_seconds(CAST(l.l_orderkey % 86400 AS BIGINT)) AS timestamp_utc,
         CAST(l.l_quantity AS DECIMAL(10,4)) AS work_unit,
         CAST(l.l_linenumber AS SMALLINT) AS raw_count,
         l.l_shipdate + to_seconds(CAST(l.l_orderkey % 86400 AS BIGINT)) AS created_at,
         CAST(l.l_orderkey * 8 + l.l_linenumber AS BIGINT) AS ingest_seq,
         sha256(concat_ws('|', CAST(year(l.l_shipdate) % 5 AS VARCHAR), CAST(s.s_nationkey AS VARCHAR),
                concat_ws('-', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR), CAST(l.l_partkey AS VARCHAR), CAST(l.l_suppkey AS VARCHAR)),
                strftime(l.l_shipdate + to_seconds(CAST(l.l_orderkey % 86400 AS BIGINT)), '%Y-%m-%dT%H:%M:%S+00:00'),
                n.n_name, '')) AS dedupe_key
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey""")

cte("campaigns", """
  SELECT CAST(r_regionkey AS BIGINT) AS event_id,
         'campaign-' || CAST(2020 + r_regionkey AS VARCHAR) || '-'
           || CASE WHEN r_regionkey % 2 = 0 THEN 'spring' ELSE 'fall' END AS slug,
         CAST(2020 + r_regionkey AS INTEGER) AS year,
         CASE WHEN r_regionkey % 2 = 0 THEN 'spring' ELSE 'fall' END AS season,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(5 * r_regionkey AS INTEGER)) AS starts_at,
         TIMESTAMP '2024-01-10 23:59:59' + to_days(CAST(5 * r_regionkey AS INTEGER)) AS ends_at,
         r_regionkey <> 3 AS is_public, r_regionkey = 4 AS is_live, r_regionkey < 4 AS is_archived,
         CASE WHEN r_regionkey = 1 THEN r_name END AS display_alias,
         CAST(NULL AS VARCHAR) AS notes
  FROM region""")

cte("sources", """
  SELECT CAST(n_nationkey AS BIGINT) AS source_id, n_name AS name,
         replace(lower(n_name), ' ', '-') AS slug,
         CAST(NULL AS VARCHAR) AS base_url,
         CASE n_nationkey % 3 WHEN 0 THEN 'api_json' WHEN 1 THEN 'biospex_json' ELSE 'digivol_json' END AS adapter_type,
         TRUE AS supports_weighting,
         CASE WHEN n_nationkey % 5 = 0 THEN 'k' END AS weight_field,
         n_nationkey % 4 <> 0 AS is_active,
         CAST(NULL AS VARCHAR) AS notes
  FROM nation""")

cte("bridge", """
  SELECT CAST(n_regionkey AS BIGINT) AS event_id, CAST(n_nationkey AS BIGINT) AS source_id,
         n_nationkey % 2 = 0 AS is_enabled
  FROM nation""")

cte("checkpoints", """
  SELECT b.event_id, b.source_id, m.last_seen_timestamp,
         CAST(NULL AS VARCHAR) AS last_page_token,
         m.last_seen_timestamp + INTERVAL 1 MINUTE AS last_run_at,
         CASE WHEN m.last_seen_timestamp IS NULL THEN 'pending'
              WHEN b.source_id % 7 = 0 THEN 'error' ELSE 'ok' END AS last_status,
         CASE WHEN m.last_seen_timestamp IS NOT NULL AND b.source_id % 7 = 0 THEN 'HTTP 500 from feed' END AS last_error
  FROM bridge b LEFT JOIN (
    SELECT event_id, source_id, max(timestamp_utc) AS last_seen_timestamp FROM records GROUP BY ALL
  ) m ON b.event_id = m.event_id AND b.source_id = m.source_id""", "bridge", "records")

cte("rollup", """
  SELECT event_id, date_trunc('hour', timestamp_utc) AS bucket_hour_utc, center,
         SUM(work_unit) AS weighted_sum, CAST(SUM(raw_count) AS BIGINT) AS raw_sum
  FROM records WHERE event_id IN (SELECT event_id FROM campaigns WHERE is_archived)
  GROUP BY ALL""", "records", "campaigns")

cte("plan", f"""
  SELECT event_id, slug, is_live, starts_at,
         CASE WHEN is_live AND starts_at IS NOT NULL AND {NOW} < starts_at + INTERVAL 60 MINUTE
              THEN 'minute' ELSE 'hour' END AS bucket_size
  FROM campaigns WHERE is_public""", "campaigns")

cte("by_center", """
  SELECT g.event_id, g.center, g.bucket_hour_utc AS bucket, g.weighted_sum AS weighted, g.raw_sum AS raw
  FROM rollup g JOIN plan p ON g.event_id = p.event_id WHERE NOT p.is_live
  UNION ALL
  SELECT r.event_id, r.center,
         date_trunc(p.bucket_size, CASE WHEN p.is_live THEN r.created_at ELSE r.timestamp_utc END) AS bucket,
         SUM(r.work_unit) AS weighted, CAST(SUM(r.raw_count) AS BIGINT) AS raw
  FROM records r JOIN plan p ON r.event_id = p.event_id
  WHERE p.is_live OR r.event_id NOT IN (SELECT DISTINCT event_id FROM rollup)
  GROUP BY ALL""", "rollup", "plan", "records")

cte("per_bucket", """
  SELECT event_id, bucket, SUM(weighted) AS weighted, CAST(SUM(raw) AS BIGINT) AS raw
  FROM by_center GROUP BY ALL""", "by_center")

cte("center_series", """
  SELECT event_id, center, bucket, weighted, raw,
         SUM(weighted) OVER (PARTITION BY event_id, center ORDER BY bucket
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_weighted,
         CAST(SUM(raw) OVER (PARTITION BY event_id, center ORDER BY bucket
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_raw
  FROM by_center""", "by_center")

cte("center_padded", """
  SELECT event_id, center, bucket, weighted, raw, cumulative_weighted, cumulative_raw FROM center_series
  UNION ALL
  SELECT event_id, center, bucket - INTERVAL 1 HOUR, 0, 0, 0, 0 FROM center_series
  WHERE (event_id, center) IN (SELECT event_id, center FROM center_series GROUP BY ALL HAVING count(*) = 1)""",
    "center_series")


def _collect(names: tuple[str, ...], out: list[str]) -> None:
    for n in names:
        if n in out:
            continue
        _collect(CTES[n][1], out)
        if n not in out:
            out.append(n)


def sql(body: str, *uses: str) -> str:
    order: list[str] = []
    _collect(uses, order)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{n} AS ({CTES[n][0]}\n)" for n in order)
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {parts},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


def _dbl(expr: str, name: str) -> str:
    return f"CAST({expr} AS DOUBLE) AS {name}"


ORACLE: dict[str, str] = {}

ORACLE["a1_hourly_rollup"] = sql("""
SELECT event_id, date_trunc('hour', timestamp_utc) AS bucket_hour_utc, center,
       CAST(SUM(work_unit) AS DOUBLE) AS weighted_sum, CAST(SUM(raw_count) AS BIGINT) AS raw_sum
FROM records GROUP BY ALL""", "records")

ORACLE["a1_hourly_rollup_large"] = sql("""
SELECT event_id, date_trunc('hour', timestamp_utc) AS bucket_hour_utc, center,
       CAST(SUM(work_unit) AS DOUBLE) AS weighted_sum, CAST(SUM(raw_count) AS BIGINT) AS raw_sum
FROM records_large GROUP BY ALL""", "records_large")

ORACLE["a12_rollup_or_raw"] = sql("""
SELECT event_id, bucket_hour_utc, center, CAST(weighted_sum AS DOUBLE) AS weighted_sum, raw_sum FROM rollup
UNION ALL
SELECT event_id, date_trunc('hour', timestamp_utc), center,
       CAST(SUM(work_unit) AS DOUBLE), CAST(SUM(raw_count) AS BIGINT)
FROM records WHERE event_id NOT IN (SELECT DISTINCT event_id FROM rollup) GROUP BY ALL""", "rollup", "records")

ORACLE["a2_activity_per_bucket"] = sql("""
SELECT event_id, bucket, CAST(weighted AS DOUBLE) AS weighted, raw FROM per_bucket""", "per_bucket")

ORACLE["a3_activity_by_center"] = sql("""
SELECT event_id, center, bucket, CAST(weighted AS DOUBLE) AS weighted, raw FROM by_center""", "by_center")

ORACLE["a4_campaign_summary"] = sql("""
SELECT c.event_id,
       CAST(COALESCE(SUM(r.work_unit), 0) AS DOUBLE) AS weighted_total,
       CAST(COALESCE(SUM(r.raw_count), 0) AS BIGINT) AS raw_total,
       CAST(COUNT(DISTINCT r.center) AS BIGINT) AS center_count,
       MIN(CASE WHEN c.is_live THEN r.created_at ELSE r.timestamp_utc END) AS first_timestamp,
       MAX(CASE WHEN c.is_live THEN r.created_at ELSE r.timestamp_utc END) AS latest_timestamp
FROM campaigns c LEFT JOIN records r ON r.event_id = c.event_id
WHERE c.is_public GROUP BY c.event_id""", "campaigns", "records")

_W1 = """
SELECT r.event_id, r.dedupe_key, {t} AS chart_ts,
       CAST(r.work_unit AS DOUBLE) AS weighted, CAST(r.raw_count AS BIGINT) AS raw,
       CAST(SUM(r.work_unit) OVER w AS DOUBLE) AS cumulative_weighted,
       CAST(SUM(r.raw_count) OVER w AS BIGINT) AS cumulative_raw
FROM {src} r JOIN campaigns c ON r.event_id = c.event_id
WHERE {where}
WINDOW w AS (PARTITION BY r.event_id ORDER BY {t}, r.dedupe_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

ORACLE["w1_record_running_total"] = sql(_W1.format(
    t="CASE WHEN c.is_live THEN r.created_at ELSE r.timestamp_utc END", src="records", where="c.is_public"),
    "records", "campaigns")

ORACLE["w1_record_running_total_large"] = sql(_W1.format(
    t="r.timestamp_utc", src="records_large", where="TRUE"), "records_large", "campaigns")

ORACLE["w2_center_running_total"] = sql("""
SELECT event_id, center, bucket, CAST(weighted AS DOUBLE) AS weighted, raw,
       CAST(cumulative_weighted AS DOUBLE) AS cumulative_weighted, cumulative_raw
FROM center_series""", "center_series")

ORACLE["w3_series_running_total"] = sql("""
SELECT event_id, bucket, CAST(weighted AS DOUBLE) AS weighted, raw,
       CAST(SUM(weighted) OVER w AS DOUBLE) AS cumulative_weighted,
       CAST(SUM(raw) OVER w AS BIGINT) AS cumulative_raw
FROM per_bucket
WINDOW w AS (PARTITION BY event_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "per_bucket")

ORACLE["w4_single_point_padding"] = sql("""
SELECT event_id, center, bucket, CAST(weighted AS DOUBLE) AS weighted, CAST(raw AS BIGINT) AS raw,
       CAST(cumulative_weighted AS DOUBLE) AS cumulative_weighted, CAST(cumulative_raw AS BIGINT) AS cumulative_raw
FROM center_padded""", "center_padded")

# The fixture's centers are its event types; one column each.
CENTERS = ["click", "error", "purchase", "signup", "view"]

ORACLE["w5_center_hour_matrix"] = sql(f"""
SELECT event_id, bucket, {", ".join(
    f"max(CAST(cumulative_weighted AS DOUBLE)) FILTER (WHERE center = '{c}') AS {c}" for c in CENTERS)}
FROM center_padded GROUP BY event_id, bucket""", "center_padded")

ORACLE["w5_center_hour_grid"] = sql("""
SELECT h.event_id, h.bucket, c.center, CAST(s.cumulative_weighted AS DOUBLE) AS cumulative_weighted
FROM (SELECT DISTINCT event_id, bucket FROM center_series) h
JOIN (SELECT DISTINCT event_id, center FROM center_series) c ON h.event_id = c.event_id
LEFT JOIN center_series s ON s.event_id = h.event_id AND s.bucket = h.bucket AND s.center = c.center""", "center_series")

ORACLE["w8_adaptive_bucket"] = sql(f"""
SELECT event_id, slug AS event, {NOW} AS generated_at, is_live, 'weighted' AS metric_mode, bucket_size
FROM plan""", "plan")

ORACLE["t1_series_order"] = sql("""
SELECT event_id, center, bucket, CAST(weighted AS DOUBLE) AS weighted, raw,
       CAST(row_number() OVER (PARTITION BY event_id ORDER BY center, bucket) AS BIGINT) AS position
FROM by_center""", "by_center")

ORACLE["u1_distinct_hours"] = sql("""
SELECT DISTINCT event_id, bucket FROM by_center""", "by_center")


# --- feeds: expected results computed straight from events ------------------

cte("feed_base", """
  SELECT b.*, s.adapter_type, s.weight_field, s.name AS source_name, s.slug AS source_slug,
         CAST(floor(b.src_id / 100) AS BIGINT) AS page_offset,
         CASE WHEN b.k % 10 <> 0 THEN 'p' || CAST(b.k % 7 AS VARCHAR) END AS project0
  FROM base b JOIN sources s ON b.source_id = s.source_id""", "base", "sources")

cte("feed_items", """
  SELECT event_id, source_id, page_offset, adapter_type, src_id, k,
         CAST(row_number() OVER (PARTITION BY event_id, source_id, page_offset ORDER BY src_id) - 1 AS BIGINT) AS item_pos,
         CASE WHEN adapter_type = 'biospex_json' THEN 'g-' || CAST(src_id AS VARCHAR) ELSE CAST(src_id AS VARCHAR) END AS item_id,
         adapter_type = 'api_json' AND k % 13 = 0 AS rejected
  FROM feed_base""", "feed_base")

cte("feed_records", """
  SELECT event_id, source_id,
         CASE WHEN adapter_type = 'biospex_json' THEN 'g-' || CAST(src_id AS VARCHAR) ELSE CAST(src_id AS VARCHAR) END AS source_guid,
         CASE WHEN adapter_type = 'digivol_json' THEN source_name ELSE event_type END AS center,
         CASE WHEN adapter_type = 'biospex_json' THEN event_type ELSE project0 END AS project,
         CASE WHEN adapter_type = 'api_json' THEN NULL ELSE 'subject ' || CAST(src_id AS VARCHAR) END AS description,
         ts AS timestamp_utc,
         CAST(CASE WHEN weight_field IS NOT NULL THEN CAST(k AS DOUBLE) ELSE value / 10 END AS DECIMAL(10,4)) AS work_unit,
         CAST(CASE WHEN adapter_type = 'biospex_json' THEN 1
                   WHEN adapter_type = 'api_json' THEN greatest(1, k % 3) ELSE 1 + k % 3 END AS BIGINT) AS raw_count
  FROM feed_base
  WHERE NOT (adapter_type = 'api_json' AND k % 13 = 0)""", "feed_base")

cte("feed_keyed", """
  SELECT *, sha256(concat_ws('|', CAST(event_id AS VARCHAR), CAST(source_id AS VARCHAR), source_guid,
                   strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S+00:00'), center, COALESCE(project, ''))) AS dedupe_key
  FROM feed_records""", "feed_records")

_FEED_COLS = ("event_id, source_id, source_guid, center, project, description, timestamp_utc, "
              "CAST(work_unit AS DOUBLE) AS work_unit, raw_count, dedupe_key")

ORACLE["s1_feed_items"] = sql("""
SELECT event_id, source_id, page_offset, item_pos, item_id FROM feed_items""", "feed_items")
ORACLE["n6_feed_records"] = sql(f"SELECT {_FEED_COLS} FROM feed_keyed", "feed_keyed")
ORACLE["n3_generic_records"] = sql(f"""
SELECT {_FEED_COLS} FROM feed_keyed WHERE source_id IN (SELECT source_id FROM sources WHERE adapter_type IN ('api_json','http_json'))""",
    "feed_keyed", "sources")
ORACLE["n4_biospex_records"] = sql(f"""
SELECT {_FEED_COLS} FROM feed_keyed WHERE source_id IN (SELECT source_id FROM sources WHERE adapter_type = 'biospex_json')""",
    "feed_keyed", "sources")
ORACLE["n5_digivol_records"] = sql(f"""
SELECT {_FEED_COLS} FROM feed_keyed WHERE source_id IN (SELECT source_id FROM sources WHERE adapter_type = 'digivol_json')""",
    "feed_keyed", "sources")
ORACLE["n1_path_coalesce"] = sql("""
SELECT source_guid, timestamp_utc FROM feed_records
WHERE source_id IN (SELECT source_id FROM sources WHERE adapter_type IN ('api_json','http_json'))""",
    "feed_records", "sources")
ORACLE["n2_weight_path"] = sql("""
SELECT source_id, source_guid, CAST(work_unit AS DOUBLE) AS work_unit FROM feed_records
WHERE source_id IN (SELECT source_id FROM sources WHERE weight_field IS NOT NULL)""", "feed_records", "sources")
ORACLE["n7_timestamp_utc"] = sql("SELECT source_id, source_guid, timestamp_utc FROM feed_records", "feed_records")
ORACLE["n8_dedupe_key"] = sql("SELECT source_guid, dedupe_key FROM feed_keyed", "feed_keyed")
ORACLE["n9_canonical_bounds"] = sql("""
SELECT source_guid, CAST(work_unit AS DOUBLE) AS work_unit, raw_count FROM feed_records""", "feed_records")
ORACLE["f1_feed_rejects"] = sql("""
SELECT event_id, source_id, page_offset, 'missing center' AS reason, item_id FROM feed_items WHERE rejected""",
    "feed_items")


# A landing with faults (sources.bindings.faulty_landing), by page.
cte("feed_pairs", """
  SELECT event_id, source_id, count(*) AS num_found, max(page_offset) AS last_page FROM feed_items GROUP BY event_id, source_id""",
    "feed_items")

cte("faulty_pages", """
  SELECT p.event_id, p.source_id, p.page_offset, p.kept, p.adapter_type, c.num_found, c.last_page,
         TIMESTAMP '2024-02-01 00:00:00' + to_minutes(p.page_offset) AS fetched_at,
         CASE WHEN p.source_id % 10 = 3 THEN 6 WHEN p.source_id % 10 = 7 THEN 2
              ELSE (p.event_id + p.source_id * 3 + p.page_offset) % 11 END AS fault
  FROM (SELECT event_id, source_id, page_offset, adapter_type, count(*) FILTER (NOT rejected) AS kept
        FROM feed_items GROUP BY event_id, source_id, page_offset, adapter_type) p
  JOIN feed_pairs c ON p.event_id = c.event_id AND p.source_id = c.source_id""", "feed_items", "feed_pairs")

cte("judged_pages", """
  SELECT *, CASE fault WHEN 0 THEN 'broken line' WHEN 1 THEN 'repeated key' WHEN 2 THEN 'unparseable timestamp'
                       WHEN 3 THEN 'value out of range' WHEN 4 THEN 'unreadable body' WHEN 5 THEN 'unknown source' END AS reason,
         CASE WHEN fault = 6 THEN NULL
              WHEN adapter_type = 'api_json' THEN CASE WHEN page_offset < last_page THEN CAST(page_offset + 1 AS VARCHAR) END
              WHEN adapter_type = 'biospex_json' THEN CASE WHEN page_offset * 100 + 100 < num_found THEN CAST(page_offset * 100 + 100 AS VARCHAR) END
              WHEN kept >= 100 THEN CAST(page_offset * 100 + kept AS VARCHAR) END AS next_token
  FROM faulty_pages""", "faulty_pages")

cte("good_records", """
  SELECT k.*, CAST(floor(CAST(regexp_extract(k.source_guid, '[0-9]+') AS BIGINT) / 100) AS BIGINT) AS page_offset
  FROM feed_keyed k
  WHERE (k.event_id, k.source_id, CAST(floor(CAST(regexp_extract(k.source_guid, '[0-9]+') AS BIGINT) / 100) AS BIGINT)) IN (
    SELECT (event_id, source_id, page_offset) FROM judged_pages WHERE fault > 6)""", "feed_keyed", "judged_pages")

cte("page_states", """
  SELECT p.event_id, p.source_id, count(*) FILTER (reason IS NULL) AS pages_ok, m.max_ts,
         max_by(struct_pack(t := next_token), page_offset) FILTER (reason IS NULL) AS token,
         max(page_offset) FILTER (reason IS NULL) AS good, max(page_offset) FILTER (reason IS NOT NULL) AS bad,
         max_by(reason || ' on page ' || CAST(page_offset AS VARCHAR), page_offset) FILTER (reason IS NOT NULL) AS message
  FROM judged_pages p
  LEFT JOIN (SELECT event_id, source_id, max(timestamp_utc) AS max_ts FROM good_records GROUP BY event_id, source_id) m
    ON p.event_id = m.event_id AND p.source_id = m.source_id
  WHERE fault NOT IN (0, 5) GROUP BY p.event_id, p.source_id, m.max_ts""", "judged_pages", "good_records")

ORACLE["s1_quarantined_pages"] = sql("""
SELECT event_id, CASE WHEN fault = 0 THEN NULL WHEN fault = 5 THEN source_id + 1000 ELSE source_id END AS source_id,
       CASE WHEN fault <> 0 THEN page_offset END AS page_offset, CASE WHEN fault <> 0 THEN fetched_at END AS fetched_at, reason,
       CASE WHEN fault = 0 THEN left('{"source_id":' || CAST(source_id AS VARCHAR) || ',"page_offset":' || CAST(page_offset AS VARCHAR)
            || ',"fetched_at":"' || strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') || '","body":"{', 60) END AS text
FROM judged_pages WHERE reason IS NOT NULL""", "judged_pages")
ORACLE["n6_good_page_records"] = sql(f"SELECT {_FEED_COLS} FROM good_records", "good_records")
ORACLE["r1_page_states"] = sql("""
SELECT event_id, source_id, pages_ok, max_ts, token.t AS next_token,
       CASE WHEN bad IS NOT NULL AND (good IS NULL OR bad >= good) THEN message END AS error
FROM page_states""", "page_states")
ORACLE["r1_faulty_checkpoints"] = sql(f"""
SELECT event_id, source_id, max_ts AS last_seen_timestamp, token.t AS last_page_token, {NOW} AS last_run_at,
       CASE WHEN bad IS NOT NULL AND (good IS NULL OR bad >= good) THEN 'error' ELSE 'ok' END AS last_status,
       CASE WHEN bad IS NOT NULL AND (good IS NULL OR bad >= good) THEN message END AS last_error
FROM page_states""", "page_states")
ORACLE["r1_stream_quarantine"] = sql("""
SELECT reason, count(*) AS pages FROM judged_pages WHERE reason IS NOT NULL GROUP BY reason""", "judged_pages")


# --- upserts -------------------------------------------------------------------

cte("replay", """
  SELECT event_id, source_id, source_guid, dedupe_key, center, project, description, timestamp_utc,
         CAST(work_unit * 2 AS DECIMAL(10,4)) AS work_unit, raw_count, payload_json,
         created_at + INTERVAL 1 DAY AS created_at, created_at + INTERVAL 1 DAY AS updated_at,
         ingest_seq + 1000000000000 AS ingest_seq
  FROM records WHERE TRY_CAST(json_extract_string(payload_json, '$.k') AS INTEGER) % 4 = 0""", "records")

cte("upserted", """
  SELECT r.event_id, r.source_id, r.dedupe_key, r.center, r.timestamp_utc, r.created_at,
         COALESCE(p.work_unit, r.work_unit) AS work_unit, COALESCE(p.raw_count, r.raw_count) AS raw_count,
         COALESCE(p.ingest_seq, r.ingest_seq) AS ingest_seq
  FROM records r LEFT JOIN replay p ON r.dedupe_key = p.dedupe_key""", "records", "replay")

cte("batch", """
  SELECT event_id, source_id,
         CASE WHEN source_id % 7 = 0 THEN NULL ELSE max(timestamp_utc) END AS max_ts,
         CAST(NULL AS VARCHAR) AS next_page_token,
         CASE WHEN source_id % 7 = 0 THEN 'feed failed: ' || repeat('x', 2100) END AS error
  FROM replay GROUP BY event_id, source_id""", "replay")

cte("dirs", """
  SELECT DISTINCT CASE WHEN y % 3 = 0 THEN CAST(y AS VARCHAR)
                       WHEN y % 3 = 1 THEN CAST(y AS VARCHAR) || '-fall'
                       ELSE CAST(y AS VARCHAR) || '-lite' END AS directory
  FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)
  UNION SELECT DISTINCT CAST(year(ts) AS VARCHAR) FROM events
  UNION SELECT r_name FROM region""")

cte("dir_attrs", f"""
  SELECT directory,
         CASE WHEN m THEN CAST(substr(directory, 1, 4) AS INTEGER) ELSE year({NOW}) END AS year,
         CASE WHEN m THEN CASE WHEN contains(suffix, 'fall') THEN 'fall' ELSE 'spring' END END AS season,
         CASE WHEN m AND suffix = 'lite' THEN substr(directory, 1, 4) END AS display_alias
  FROM (SELECT directory, regexp_full_match(directory, '\\d{{4}}(-.+)?') AS m,
               lower(trim(regexp_extract(directory, '^\\d{{4}}-(.+)$', 1))) AS suffix FROM dirs)""", "dirs")

cte("dir_campaigns", """
  SELECT year, season,
         make_timestamp(year, 1, 1, 0, 0, 0) AS starts_at,
         make_timestamp(year, 12, 31, 23, 59, 59) AS ends_at,
         TRUE AS is_public, FALSE AS is_live, TRUE AS is_archived,
         arg_max_null(display_alias, directory) AS display_alias,
         'Imported from legacy CSVs in ' || max(directory) AS notes
  FROM dir_attrs GROUP BY year, season""", "dir_attrs")

ORACLE["w7_keep_last"] = sql("""
SELECT dedupe_key, CAST(arg_max(work_unit, ingest_seq) AS DOUBLE) AS work_unit, max(ingest_seq) AS ingest_seq
FROM (SELECT dedupe_key, work_unit, ingest_seq FROM records
      UNION ALL SELECT dedupe_key, work_unit, ingest_seq FROM replay)
GROUP BY dedupe_key""", "records", "replay")

ORACLE["m1_record_upsert"] = sql("""
SELECT dedupe_key, event_id, center, CAST(work_unit AS DOUBLE) AS work_unit, CAST(raw_count AS BIGINT) AS raw_count,
       created_at, ingest_seq
FROM upserted""", "upserted")

ORACLE["m2_rollup_upsert"] = sql("""
SELECT event_id, bucket_hour_utc, center, CAST(weighted_sum AS DOUBLE) AS weighted_sum, raw_sum FROM rollup
WHERE event_id NOT IN (SELECT DISTINCT event_id FROM replay)
UNION ALL
SELECT event_id, date_trunc('hour', timestamp_utc), center, CAST(SUM(work_unit) AS DOUBLE), CAST(SUM(raw_count) AS BIGINT)
FROM upserted WHERE event_id IN (SELECT DISTINCT event_id FROM replay) GROUP BY ALL""", "rollup", "upserted", "replay")

ORACLE["m3_checkpoint_upsert"] = sql(f"""
SELECT COALESCE(c.event_id, b.event_id) AS event_id, COALESCE(c.source_id, b.source_id) AS source_id,
       CASE WHEN ran AND b.error IS NULL THEN greatest(c.last_seen_timestamp, b.max_ts) ELSE c.last_seen_timestamp END
         AS last_seen_timestamp,
       CASE WHEN ran AND b.error IS NULL THEN b.next_page_token ELSE c.last_page_token END AS last_page_token,
       CASE WHEN ran THEN {NOW} ELSE c.last_run_at END AS last_run_at,
       CASE WHEN ran AND b.error IS NULL THEN 'ok' WHEN ran THEN 'error' ELSE COALESCE(c.last_status, 'pending') END
         AS last_status,
       CASE WHEN ran AND b.error IS NULL THEN NULL WHEN ran THEN substr(b.error, 1, 2000) ELSE c.last_error END
         AS last_error
FROM (SELECT *, FALSE AS _x FROM checkpoints) c
FULL OUTER JOIN (SELECT *, (max_ts IS NOT NULL OR error IS NOT NULL OR next_page_token IS NOT NULL) AS ran FROM batch) b
  ON c.event_id = b.event_id AND c.source_id = b.source_id""", "checkpoints", "batch")

ORACLE["a11_cursor_advance"] = sql("""
SELECT COALESCE(c.event_id, b.event_id) AS event_id, COALESCE(c.source_id, b.source_id) AS source_id,
       greatest(c.last_seen_timestamp, b.batch_max) AS last_seen_timestamp
FROM checkpoints c FULL OUTER JOIN
     (SELECT event_id, source_id, max(timestamp_utc) AS batch_max FROM replay GROUP BY ALL) b
  ON c.event_id = b.event_id AND c.source_id = b.source_id""", "checkpoints", "replay")

ORACLE["m4_campaign_upsert"] = sql("""
WITH j AS (
  SELECT o.event_id AS old_id, o.event_id IS NULL AS is_new,
         COALESCE(o.year, n.year) AS year,
         CASE WHEN o.event_id IS NULL THEN n.season ELSE o.season END AS season,
         CASE WHEN n.year IS NOT NULL THEN n.starts_at ELSE o.starts_at END AS starts_at,
         CASE WHEN n.year IS NOT NULL THEN n.ends_at ELSE o.ends_at END AS ends_at,
         CASE WHEN n.year IS NOT NULL THEN n.is_public ELSE o.is_public END AS is_public,
         CASE WHEN n.year IS NOT NULL THEN n.is_live ELSE o.is_live END AS is_live,
         CASE WHEN n.year IS NOT NULL THEN n.is_archived ELSE o.is_archived END AS is_archived,
         CASE WHEN n.year IS NOT NULL THEN n.display_alias ELSE o.display_alias END AS display_alias,
         CASE WHEN n.year IS NOT NULL THEN n.notes ELSE o.notes END AS notes
  FROM campaigns o FULL OUTER JOIN dir_campaigns n ON o.year = n.year AND o.season IS NOT DISTINCT FROM n.season),
ids AS (
  SELECT CASE WHEN is_new THEN (SELECT max(event_id) FROM campaigns)
              + row_number() OVER (PARTITION BY is_new ORDER BY year, season NULLS FIRST) ELSE old_id END AS event_id, *
  FROM j)
SELECT CAST(event_id AS BIGINT) AS event_id, year, season, starts_at, ends_at, is_public, is_live, is_archived,
       display_alias, notes,
       'campaign-' || CAST(year AS VARCHAR) || COALESCE('-' || season, '') AS slug
FROM ids""", "campaigns", "dir_campaigns")

ORACLE["m5_source_defaults"] = sql("""
WITH d(slug, name, adapter_type, supports_weighting, is_active, weight_field) AS (VALUES
  ('digivol', 'DigiVol', 'digivol_json', FALSE, TRUE, NULL),
  ('les-herbonautes', 'Les Herbonautes', 'api_json', TRUE, FALSE, 'discretionaryState.workUnit'),
  ('smithsonian', 'Smithsonian Transcription Center', 'api_json', FALSE, FALSE, NULL),
  ('notes-from-nature', 'Notes From Nature (BioSpex)', 'biospex_json', FALSE, TRUE, NULL),
  ('doedat', 'DoeDat', 'api_json', FALSE, FALSE, NULL),
  ('citsciscribe', 'CitSciScribe', 'api_json', FALSE, FALSE, NULL))
SELECT CASE WHEN o.slug IS NULL
            THEN (SELECT max(source_id) FROM sources) + row_number() OVER (PARTITION BY o.slug IS NULL ORDER BY d.slug)
            ELSE o.source_id END AS source_id,
       COALESCE(o.slug, d.slug) AS slug,
       COALESCE(NULLIF(o.name, ''), d.name) AS name,
       COALESCE(NULLIF(o.adapter_type, ''), d.adapter_type) AS adapter_type,
       CASE WHEN o.slug IS NULL THEN d.supports_weighting ELSE o.supports_weighting END AS supports_weighting,
       CASE WHEN o.slug IS NULL THEN d.is_active ELSE o.is_active END AS is_active,
       COALESCE(NULLIF(o.weight_field, ''), CAST(d.weight_field AS VARCHAR)) AS weight_field
FROM sources o FULL OUTER JOIN d ON o.slug = d.slug""", "sources")

ORACLE["m6_bridge_upsert"] = sql("""
SELECT COALESCE(b.event_id, s.event_id) AS event_id, COALESCE(b.source_id, s.source_id) AS source_id,
       CASE WHEN s.event_id IS NOT NULL THEN TRUE ELSE b.is_enabled END AS is_enabled
FROM bridge b FULL OUTER JOIN (SELECT DISTINCT event_id, source_id FROM records_large) s
  ON b.event_id = s.event_id AND b.source_id = s.source_id""", "bridge", "records_large")

ORACLE["j10_cascade_delete"] = sql("""
SELECT count(*) AS n_rows, 'records' AS table_name FROM records WHERE event_id <> 2 AND source_id <> 7
UNION ALL SELECT count(*), 'rollup' FROM rollup WHERE event_id <> 2
UNION ALL SELECT count(*), 'checkpoints' FROM checkpoints WHERE event_id <> 2 AND source_id <> 7
UNION ALL SELECT count(*), 'bridge' FROM bridge WHERE event_id <> 2 AND source_id <> 7
UNION ALL SELECT count(*), 'campaigns' FROM campaigns WHERE event_id <> 2
UNION ALL SELECT count(*), 'sources' FROM sources WHERE source_id <> 7""",
    "records", "rollup", "checkpoints", "bridge", "campaigns", "sources")

# --- filters, joins, reports -----------------------------------------------------

ORACLE["f2_active_now"] = sql(f"""
SELECT event_id, slug FROM campaigns
WHERE NOT is_archived AND is_live AND {NOW} BETWEEN starts_at AND ends_at""", "campaigns")
ORACLE["f3_public_only"] = sql("SELECT event_id, slug FROM campaigns WHERE is_public", "campaigns")
ORACLE["f4_not_archived"] = sql("SELECT event_id, slug FROM campaigns WHERE NOT is_archived", "campaigns")
ORACLE["f5_search_campaigns"] = sql("""
SELECT event_id, slug FROM campaigns WHERE display_alias ILIKE '%ameri%' OR slug ILIKE '%ameri%'""", "campaigns")
ORACLE["f5_search_sources"] = sql("""
SELECT source_id, name FROM sources
WHERE name ILIKE '%nation_1%' OR slug ILIKE '%nation_1%' OR base_url ILIKE '%nation_1%'""", "sources")
ORACLE["f6_flag_filters"] = sql("SELECT event_id FROM campaigns WHERE is_public AND NOT is_live", "campaigns")
ORACLE["f6_source_flag_filters"] = sql("SELECT source_id FROM sources WHERE is_active", "sources")
ORACLE["f7_recent_activity"] = sql(f"""
SELECT event_id FROM campaigns WHERE event_id IN (
  SELECT event_id FROM checkpoints WHERE last_run_at >= {NOW} - INTERVAL 5 MINUTE)""", "campaigns", "checkpoints")

ORACLE["j1_ingest_plan"] = sql(f"""
SELECT b.source_id, c.event_id, c.slug, s.slug AS source_slug, s.adapter_type
FROM campaigns c JOIN bridge b ON b.event_id = c.event_id JOIN sources s ON s.source_id = b.source_id
WHERE NOT c.is_archived AND c.is_live AND {NOW} BETWEEN c.starts_at AND c.ends_at
  AND b.is_enabled AND s.is_active""", "campaigns", "bridge", "sources")

ORACLE["j2_records_with_campaign"] = sql("""
SELECT r.dedupe_key, r.event_id, CAST(c.year AS BIGINT) AS year, c.season FROM records r JOIN campaigns c ON r.event_id = c.event_id""",
    "records", "campaigns")

ORACLE["j3_campaign_child_counts"] = sql("""
SELECT c.event_id, c.slug,
       (SELECT count(*) FROM records r WHERE r.event_id = c.event_id) AS records_count,
       (SELECT count(*) FROM bridge b WHERE b.event_id = c.event_id) AS sources_count,
       (SELECT count(*) FROM rollup g WHERE g.event_id = c.event_id) AS aggregates_count,
       (SELECT count(*) FROM checkpoints k WHERE k.event_id = c.event_id) AS checkpoints_count
FROM campaigns c""", "campaigns", "records", "bridge", "rollup", "checkpoints")

ORACLE["j3_source_child_counts"] = sql("""
SELECT s.source_id, s.slug, (SELECT count(*) FROM bridge b WHERE b.source_id = s.source_id) AS campaigns_count
FROM sources s""", "sources", "bridge")

ORACLE["j4_checkpoint_labels"] = sql("""
SELECT k.source_id, k.event_id, k.last_status,
       COALESCE(c.slug, 'unknown-event') AS event_slug, COALESCE(s.slug, 'unknown-source') AS source_slug
FROM (SELECT event_id, source_id, last_status FROM checkpoints
      UNION ALL SELECT event_id + 100, source_id, last_status FROM checkpoints) k
LEFT JOIN campaigns c ON c.event_id = k.event_id LEFT JOIN sources s ON s.source_id = k.source_id""",
    "checkpoints", "campaigns", "sources")

ORACLE["j5_campaigns_with_records"] = sql("""
SELECT event_id FROM campaigns c WHERE EXISTS (SELECT 1 FROM records r WHERE r.event_id = c.event_id)""",
    "campaigns", "records")
ORACLE["j6_campaigns_without_rollup"] = sql("""
SELECT event_id FROM campaigns WHERE event_id NOT IN (SELECT event_id FROM rollup)""", "campaigns", "rollup")
ORACLE["j7_fallback_records"] = sql("""
SELECT dedupe_key, event_id FROM records
WHERE event_id IN (SELECT event_id FROM campaigns WHERE event_id NOT IN (SELECT event_id FROM rollup))""",
    "records", "campaigns", "rollup")
ORACLE["j8_campaign_totals"] = sql("""
SELECT i.event_id, COALESCE(t.total, 0) AS total
FROM (SELECT event_id FROM campaigns UNION ALL SELECT event_id + 5 FROM campaigns) i
LEFT JOIN (SELECT event_id, CAST(SUM(raw_count) AS BIGINT) AS total FROM records_large GROUP BY ALL) t
  ON t.event_id = i.event_id""", "campaigns", "records_large")
ORACLE["j9_source_names"] = sql("""
SELECT c.event_id, c.slug, n.source_names FROM campaigns c LEFT JOIN (
  SELECT b.event_id, string_agg(s.name, ', ' ORDER BY s.name) AS source_names
  FROM bridge b JOIN sources s ON s.source_id = b.source_id GROUP BY b.event_id) n ON n.event_id = c.event_id""",
    "campaigns", "bridge", "sources")

ORACLE["a5_transactions_per_campaign"] = sql("""
WITH t AS (
  SELECT event_id, CAST(SUM(raw_sum) AS BIGINT) AS total FROM rollup GROUP BY event_id
  UNION ALL
  SELECT event_id, count(*) FROM records
  WHERE event_id IN (SELECT event_id FROM campaigns WHERE event_id NOT IN (SELECT event_id FROM rollup))
  GROUP BY event_id)
SELECT c.event_id,
       CASE WHEN trim(COALESCE(c.season, '')) = '' THEN CAST(c.year AS VARCHAR)
            ELSE CAST(c.year AS VARCHAR) || ' ' || upper(substr(trim(c.season), 1, 1)) || substr(trim(c.season), 2) END
         AS label,
       COALESCE(t.total, 0) AS total_transactions,
       row_number() OVER (ORDER BY c.year, CASE c.season WHEN 'spring' THEN 1 WHEN 'fall' THEN 2 ELSE 3 END, c.slug)
         AS position
FROM campaigns c LEFT JOIN t ON t.event_id = c.event_id""", "campaigns", "rollup", "records")

ORACLE["a6_transactions_per_year"] = sql("""
SELECT CAST(c.year AS BIGINT) AS year, count(*) AS transactions FROM records r JOIN campaigns c ON r.event_id = c.event_id
GROUP BY c.year""", "records", "campaigns")

ORACLE["a7_admin_stats"] = sql("""
SELECT count(*) AS sources_total, count(*) FILTER (WHERE is_active) AS sources_active,
       greatest(0, count(*) - count(*) FILTER (WHERE is_active)) AS sources_inactive,
       (SELECT count(*) FROM campaigns) AS campaigns_total,
       (SELECT count(*) FILTER (WHERE last_status = 'error') FROM checkpoints) AS checkpoints_in_error
FROM sources""", "sources", "campaigns", "checkpoints")

ORACLE["a8_observed_window"] = sql("""
SELECT c.event_id, COALESCE(w.mn, c.starts_at) AS starts_at, COALESCE(w.mx, c.ends_at) AS ends_at
FROM (SELECT * FROM campaigns UNION ALL SELECT * REPLACE (CAST(5 AS BIGINT) AS event_id) FROM campaigns
      WHERE event_id = 4) c
LEFT JOIN (SELECT event_id, min(timestamp_utc) AS mn, max(timestamp_utc) AS mx FROM records GROUP BY ALL) w
  ON w.event_id = c.event_id""", "campaigns", "records")

ORACLE["a9_sources_seen"] = sql("SELECT DISTINCT event_id, source_id FROM records_large", "records_large")

ORACLE["t2_list_campaigns"] = sql("""
SELECT event_id, starts_at, row_number() OVER (ORDER BY starts_at DESC, event_id) AS position FROM campaigns""",
    "campaigns")
ORACLE["t2_list_sources"] = sql("""
SELECT source_id, name, row_number() OVER (ORDER BY name, source_id) AS position FROM sources""", "sources")
ORACLE["t3_season_order"] = sql("""
SELECT year, season, 'campaign-' || CAST(year AS VARCHAR) || COALESCE('-' || season, '') AS slug,
       row_number() OVER (ORDER BY year, CASE season WHEN 'spring' THEN 1 WHEN 'fall' THEN 2 ELSE 3 END,
                          'campaign-' || CAST(year AS VARCHAR) || COALESCE('-' || season, '')) AS position
FROM dir_campaigns""", "dir_campaigns")
ORACLE["t4_latest_checkpoint"] = sql("""
SELECT event_id, source_id, last_run_at, last_status FROM checkpoints
ORDER BY last_run_at DESC NULLS LAST, event_id, source_id LIMIT 1""", "checkpoints")
ORACLE["t5_first_live_public"] = sql("""
SELECT event_id, slug FROM campaigns WHERE is_live AND is_public ORDER BY event_id LIMIT 1""", "campaigns")

ORACLE["u2_union_by_name"] = sql("""
SELECT 'records' AS origin, event_id, count(*) AS n, count(ingest_seq) AS n_with_seq FROM records GROUP BY event_id
UNION ALL
SELECT 'feeds', event_id, count(*), 0 FROM feed_records GROUP BY event_id""", "records", "feed_records")
ORACLE["u3_id_difference"] = sql("""
SELECT event_id FROM campaigns EXCEPT SELECT event_id FROM rollup""", "campaigns", "rollup")

ORACLE["n16_directory_attributes"] = sql("SELECT directory, year, season, display_alias FROM dir_attrs", "dir_attrs")

ORACLE["n17_n19_campaign_labels"] = sql("""
SELECT event_id,
       'campaign-' || CAST(year AS VARCHAR) || COALESCE('-' || season, '') AS canonical_slug,
       COALESCE(NULLIF(trim(display_alias), ''),
                'Campaign ' || CAST(year AS VARCHAR) || COALESCE(' ' || upper(substr(season, 1, 1)) || substr(season, 2), ''))
         AS display_name,
       CASE WHEN trim(COALESCE(season, '')) = '' THEN CAST(year AS VARCHAR)
            ELSE CAST(year AS VARCHAR) || ' ' || upper(substr(trim(season), 1, 1)) || substr(trim(season), 2) END
         AS report_label
FROM (SELECT event_id, year, season, display_alias FROM campaigns
      UNION ALL SELECT CAST(NULL AS BIGINT), year, season, display_alias FROM dir_campaigns)""",
    "campaigns", "dir_campaigns")

ORACLE["n20_zone_conversion"] = sql("""
SELECT event_id,
       CAST(timezone('UTC', timezone('Pacific/Tongatapu', starts_at)) AS TIMESTAMP) AS starts_at_from_wall,
       CAST(timezone('America/New_York', timezone('UTC', starts_at)) AS TIMESTAMP) AS starts_at_display,
       strftime(starts_at, '%Y-%m-%d %H:00') AS starts_hour_label,
       strftime(CAST(timezone('America/New_York', timezone('UTC', starts_at)) AS TIMESTAMP), '%Y-%m-%d %H:00')
         AS starts_hour_label_local
FROM campaigns""", "campaigns")

ORACLE["n21_no_data_state"] = sql(f"""
SELECT event_id,
       CASE WHEN is_live AND {NOW} < starts_at THEN 'countdown' WHEN is_live THEN 'waiting' ELSE 'unavailable' END
         AS state,
       CASE WHEN is_live AND {NOW} < starts_at THEN CAST(floor(date_diff('second', {NOW}, starts_at) / 60 / 60) AS BIGINT) END
         AS hours,
       CASE WHEN is_live AND {NOW} < starts_at THEN CAST(floor(date_diff('second', {NOW}, starts_at) / 60) AS BIGINT) % 60 END
         AS minutes
FROM campaigns
WHERE is_public AND event_id NOT IN (
  SELECT event_id FROM feed_records WHERE event_id <> 0
    AND source_id IN (SELECT source_id FROM sources WHERE is_active))""", "campaigns", "feed_records", "sources")

cte("slug_input", """
  SELECT event_id, year, season, slug FROM campaigns
  UNION ALL
  SELECT CAST(1000 + dense_rank() OVER (ORDER BY year, season NULLS FIRST) AS BIGINT), year, season, CAST(NULL AS VARCHAR)
  FROM dir_campaigns""", "campaigns", "dir_campaigns")

ORACLE["w6_slug_suffix"] = sql("""
SELECT event_id, slug,
       CASE WHEN rn > 1 THEN base || '-' || CAST(rn AS VARCHAR) ELSE base END AS new_slug,
       (year IS NULL OR coalesce(trim(season), '') = '') AS skipped
FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY event_id) AS rn
      FROM (SELECT *, 'campaign-' || CAST(year AS VARCHAR) || COALESCE('-' || season, '') AS base FROM slug_input))""",
    "slug_input")

# Campaigns in id order, with the suffixes (1 for the base itself) that others hold when their turn comes.
ORACLE["w6_free_slugs"] = sql("""
WITH RECURSIVE c AS (
  SELECT event_id, year, season, slug FROM campaigns
  UNION ALL
  SELECT event_id + 10 * copy, CASE WHEN copy = 3 THEN year + 2 ELSE year END, CASE WHEN copy <> 2 THEN season END,
         slug || '-' || CAST(5 - copy AS VARCHAR)
  FROM campaigns, (SELECT unnest([1, 2, 3]) AS copy)),
b AS (
  SELECT *, 'campaign-' || CAST(year AS VARCHAR) || COALESCE('-' || season, '') AS base, season IS NULL AS skipped FROM c),
m AS (SELECT event_id, base, row_number() OVER (PARTITION BY base ORDER BY event_id) AS n FROM b WHERE NOT skipped),
o AS (
  SELECT m.base, m.n, b.event_id AS holder, k
  FROM m JOIN b ON b.event_id <> m.event_id AND (b.skipped OR b.event_id > m.event_id)
  JOIN (SELECT unnest(range(1, 60)) AS k) ON b.slug = CASE WHEN k = 1 THEN m.base ELSE m.base || '-' || CAST(k AS VARCHAR) END),
l AS (
  SELECT m.event_id, m.base, m.n, coalesce((SELECT list(k) FROM o WHERE o.base = m.base AND o.n = m.n), CAST([] AS BIGINT[])) AS held FROM m),
r AS (
  SELECT event_id, base, n, list_min(list_filter(range(1, 60), lambda x: NOT list_contains(held, x))) AS k,
         [list_min(list_filter(range(1, 60), lambda x: NOT list_contains(held, x)))] AS given
  FROM l WHERE n = 1
  UNION ALL
  SELECT l.event_id, l.base, l.n,
         list_min(list_filter(range(1, 60), lambda x: NOT list_contains(l.held, x) AND NOT list_contains(r.given, x))),
         list_append(r.given, list_min(list_filter(range(1, 60), lambda x: NOT list_contains(l.held, x) AND NOT list_contains(r.given, x))))
  FROM r JOIN l ON l.base = r.base AND l.n = r.n + 1)
SELECT b.event_id, b.slug, CASE WHEN r.k = 1 THEN b.base WHEN r.k > 1 THEN b.base || '-' || CAST(r.k AS VARCHAR) END AS new_slug, b.skipped
FROM b LEFT JOIN r ON b.event_id = r.event_id""", "campaigns")

ORACLE["w6_slug_backfill_report"] = sql("""
WITH i AS (
  SELECT event_id, year, season, slug FROM campaigns
  UNION ALL
  SELECT event_id + 10, year, CASE WHEN event_id = 2 THEN NULL ELSE season END, CAST(NULL AS VARCHAR) FROM campaigns),
s AS (
  SELECT *, CASE WHEN rn > 1 THEN base || '-' || CAST(rn AS VARCHAR) ELSE base END AS new_slug,
         (year IS NULL OR coalesce(trim(season), '') = '') AS skipped
  FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY event_id) AS rn
        FROM (SELECT *, 'campaign-' || CAST(year AS VARCHAR) || COALESCE('-' || season, '') AS base FROM i)))
SELECT count(*) FILTER (WHERE NOT skipped AND slug IS DISTINCT FROM new_slug) AS updated,
       count(*) FILTER (WHERE skipped OR slug IS NOT DISTINCT FROM new_slug) AS skipped
FROM s""", "campaigns")

ORACLE["r6_health_report"] = sql("""
SELECT COALESCE(c.slug, 'unknown-event') || ' / ' || COALESCE(s.slug, 'unknown-source') AS latest_pair,
       COALESCE(k.last_status, 'none') AS latest_status, k.last_run_at,
       (SELECT count(*) FILTER (WHERE last_status = 'error') FROM checkpoints) AS checkpoints_in_error
FROM (SELECT * FROM checkpoints ORDER BY last_run_at DESC NULLS LAST, event_id, source_id LIMIT 1) k
LEFT JOIN campaigns c ON c.event_id = k.event_id LEFT JOIN sources s ON s.source_id = k.source_id""",
    "checkpoints", "campaigns", "sources")


# --- quality audits, feed audit ----------------------------------------------------

cte("camp_plus", """
  SELECT event_id, slug, year, season, starts_at, ends_at, is_public, is_live, is_archived, display_alias, notes
  FROM campaigns
  UNION ALL
  SELECT CAST(1000 + dense_rank() OVER (ORDER BY year, season NULLS FIRST) AS BIGINT),
         'campaign-' || CAST(year AS VARCHAR) || COALESCE('-' || season, ''),
         year, season, starts_at, ends_at, is_public, is_live, is_archived, display_alias, notes
  FROM dir_campaigns""", "campaigns", "dir_campaigns")

ORACLE["q1_unique_keys"] = sql("""
SELECT 'Q1' AS rule, 'campaigns' AS table_name,
       concat_ws('|', COALESCE(CAST(year AS VARCHAR), 'NULL'), COALESCE(season, 'NULL')) AS row_key,
       'count=' || CAST(count(*) AS VARCHAR) AS detail
FROM camp_plus GROUP BY year, season HAVING count(*) > 1
UNION ALL
SELECT 'Q1', 'campaigns', COALESCE(slug, 'NULL'), 'count=' || CAST(count(*) AS VARCHAR)
FROM camp_plus GROUP BY slug HAVING count(*) > 1
UNION ALL
SELECT 'Q1', 'bridge', CAST(event_id AS VARCHAR) || '|' || CAST(source_id AS VARCHAR), 'count=' || CAST(count(*) AS VARCHAR)
FROM (SELECT event_id, source_id FROM bridge UNION ALL SELECT DISTINCT event_id, source_id FROM records_large)
GROUP BY event_id, source_id HAVING count(*) > 1
UNION ALL
SELECT 'Q1', 'records', dedupe_key, 'count=' || CAST(count(*) AS VARCHAR)
FROM (SELECT dedupe_key FROM records UNION ALL SELECT dedupe_key FROM replay)
GROUP BY dedupe_key HAVING count(*) > 1""", "camp_plus", "bridge", "records_large", "records", "replay")

ORACLE["q2_single_live"] = sql("""
WITH c AS (SELECT event_id, is_live OR event_id = 3 AS is_live FROM campaigns)
SELECT 'Q2' AS rule, 'campaigns' AS table_name, CAST(event_id AS VARCHAR) AS row_key,
       'live campaigns=' || CAST((SELECT count(*) FROM c WHERE is_live) AS VARCHAR) AS detail
FROM c WHERE is_live AND (SELECT count(*) FROM c WHERE is_live) > 1""", "campaigns")

ORACLE["q3_window_consistency"] = sql("""
SELECT 'Q3' AS rule, 'campaigns' AS table_name, CAST(event_id AS VARCHAR) AS row_key, msg AS detail FROM (
  SELECT event_id, 'start year differs from campaign year' AS msg FROM camp_plus WHERE year(starts_at) <> year
  UNION ALL SELECT event_id, 'end year differs from campaign year' FROM camp_plus WHERE year(ends_at) <> year
  UNION ALL SELECT event_id, 'end not in the start year' FROM camp_plus WHERE year(ends_at) <> year(starts_at)
  UNION ALL SELECT event_id, 'end not after start' FROM camp_plus WHERE ends_at <= starts_at)""", "camp_plus")

ORACLE["q4_required_and_ranges"] = sql("""
SELECT 'Q4' AS rule, t AS table_name, CAST(k AS VARCHAR) AS row_key, msg AS detail FROM (
  SELECT 'campaigns' AS t, event_id AS k, 'year outside 2000-2100' AS msg FROM camp_plus
   WHERE year IS NULL OR NOT (year BETWEEN 2000 AND 2100)
  UNION ALL SELECT 'campaigns', event_id, 'missing start or end' FROM camp_plus WHERE starts_at IS NULL OR ends_at IS NULL
  UNION ALL SELECT 'campaigns', event_id, 'display alias longer than 255' FROM camp_plus WHERE length(display_alias) > 255
  UNION ALL SELECT 'sources', source_id, 'missing name' FROM sources WHERE name IS NULL OR trim(name) = ''
  UNION ALL SELECT 'sources', source_id, 'missing slug' FROM sources WHERE slug IS NULL OR trim(slug) = ''
  UNION ALL SELECT 'sources', source_id, 'name longer than 255' FROM sources WHERE length(name) > 255)""",
    "camp_plus", "sources")

ORACLE["q5_allowed_values"] = sql("""
SELECT 'Q5' AS rule, 'campaigns' AS table_name, CAST(event_id AS VARCHAR) AS row_key, 'season=' || season AS detail
FROM camp_plus WHERE season IS NOT NULL AND season NOT IN ('spring', 'fall')
UNION ALL
SELECT 'Q5', 'sources', CAST(source_id AS VARCHAR), 'adapter_type=' || COALESCE(adapter_type, 'NULL')
FROM sources WHERE adapter_type IS NULL OR adapter_type NOT IN ('api_json', 'http_json', 'biospex_json', 'digivol_json')""",
    "camp_plus", "sources")

ORACLE["q6_record_bounds"] = sql("""
WITH c AS (
  SELECT dedupe_key, CAST(work_unit AS DOUBLE) * 50000 AS w,
         CAST(TRY_CAST(json_extract_string(payload_json, '$.k') AS INTEGER) * 3 AS BIGINT) AS n
  FROM records)
SELECT 'Q6' AS rule, 'records' AS table_name, dedupe_key AS row_key, 'raw_count=' || CAST(n AS VARCHAR) AS detail
FROM c WHERE NOT (n BETWEEN 1 AND 255)
UNION ALL
SELECT 'Q6', 'records', dedupe_key, 'work_unit does not fit decimal(10,4)'
FROM c WHERE w IS NOT NULL AND TRY_CAST(w AS DECIMAL(10,4)) IS NULL""", "records")

ORACLE["q7_referential_integrity"] = sql("""
WITH cp AS (SELECT event_id, source_id FROM checkpoints UNION ALL SELECT event_id + 100, source_id + 100 FROM checkpoints)
SELECT 'Q7' AS rule, t AS table_name, CAST(k AS VARCHAR) AS row_key, msg AS detail FROM (
  SELECT 'records' AS t, event_id AS k, 'unknown campaign' AS msg FROM records_large
   WHERE event_id NOT IN (SELECT event_id FROM campaigns)
  UNION ALL SELECT 'records', source_id, 'unknown source' FROM records_large
   WHERE source_id NOT IN (SELECT source_id FROM sources)
  UNION ALL SELECT 'checkpoints', event_id, 'unknown campaign' FROM cp WHERE event_id NOT IN (SELECT event_id FROM campaigns)
  UNION ALL SELECT 'checkpoints', source_id, 'unknown source' FROM cp WHERE source_id NOT IN (SELECT source_id FROM sources)
  UNION ALL SELECT 'bridge', event_id, 'unknown campaign' FROM bridge WHERE event_id NOT IN (SELECT event_id FROM campaigns)
  UNION ALL SELECT 'bridge', source_id, 'unknown source' FROM bridge WHERE source_id NOT IN (SELECT source_id FROM sources)
  UNION ALL SELECT 'rollup', event_id, 'unknown campaign' FROM rollup WHERE event_id NOT IN (SELECT event_id FROM campaigns))""",
    "records_large", "campaigns", "sources", "checkpoints", "bridge", "rollup")

ORACLE["r5_missing_next_pages"] = sql("""
WITH pg AS (
  SELECT event_id, source_id, page_offset, any_value(adapter_type) AS adapter_type,
         count(*) AS items_read, count(*) FILTER (WHERE NOT (adapter_type = 'api_json' AND k % 13 = 0)) AS items_kept
  FROM feed_base GROUP BY event_id, source_id, page_offset),
nx AS (
  SELECT *, CASE WHEN page_offset < max(page_offset) OVER (PARTITION BY event_id, source_id)
                 THEN page_offset + 1 END AS next_any,
         sum(items_read) OVER (PARTITION BY event_id, source_id) AS num_found
  FROM pg),
landed AS (SELECT * FROM nx WHERE page_offset % 7 <> 3),
ex AS (
  SELECT event_id, source_id, page_offset, items_read, items_kept,
         CASE WHEN adapter_type = 'api_json' THEN next_any
              WHEN adapter_type = 'biospex_json' THEN
                CASE WHEN page_offset * 100 + 100 < num_found THEN CAST(floor((page_offset * 100 + 100) / 100) AS BIGINT) END
              ELSE CASE WHEN items_kept >= 100 THEN CAST(floor((page_offset * 100 + items_kept) / 100) AS BIGINT) END
         END AS expected_next
  FROM landed)
SELECT event_id, source_id, page_offset, expected_next, items_read, items_kept FROM ex
WHERE expected_next IS NOT NULL
  AND (event_id, source_id, expected_next) NOT IN (SELECT event_id, source_id, page_offset FROM landed)""", "feed_base")


# --- historical CSV import: expected results from events ------------------------------

cte("csv_base", """
  SELECT b.*,
         ['2024', '2024-fall', '2024-lite'][CAST(b.user_id % 3 AS INTEGER) + 1] AS campaign_dir,
         CAST((b.user_id // 3) % 5 AS INTEGER) AS ftype,
         b.k % 19 = 0 OR b.k % 17 = 0 AS bad_ts
  FROM base b""", "base")

cte("csv_records", """
  SELECT CAST(CASE WHEN campaign_dir = '2024-fall' THEN 5 ELSE 4 END AS BIGINT) AS event_id,
         CAST(CASE WHEN ftype = 0 THEN 26 WHEN ftype = 1 THEN 30 WHEN ftype = 3 THEN 29
                   ELSE CASE event_type WHEN 'click' THEN 26 WHEN 'signup' THEN 30 WHEN 'purchase' THEN 28 ELSE 29 END
              END AS BIGINT) AS source_id,
         CASE WHEN ftype = 2 AND k % 11 = 0 THEN 'id-' || CAST(src_id AS VARCHAR) ELSE 'e' || CAST(src_id AS VARCHAR) END
           AS source_guid,
         CASE WHEN ftype = 0 THEN 'DigiVol' WHEN ftype = 1 THEN 'SITC' WHEN ftype = 3 THEN 'Notes From Nature'
              ELSE CASE event_type WHEN 'click' THEN 'DigiVol' WHEN 'signup' THEN 'SITC Center'
                                   WHEN 'purchase' THEN 'Les herbonautes' ELSE 'Notes From Nature' END END AS center,
         CASE WHEN k % 10 = 0 THEN NULL ELSE 'p' || CAST(k % 7 AS VARCHAR) END AS project,
         CASE WHEN ftype = 2 THEN CASE event_type WHEN 'click' THEN 'transcribed via DigiVol'
                                   WHEN 'view' THEN 'Notes from Nature expedition' WHEN 'error' THEN 'misc'
                                   WHEN 'signup' THEN 'Smithsonian SITC task' ELSE 'herbonaut sheets' END
              WHEN k % 37 = 0 THEN 'subject ' || CAST(src_id AS VARCHAR) || chr(10) || 'second line'
              ELSE 'subject ' || CAST(src_id AS VARCHAR) || ', sheet' END AS description,
         date_trunc('second', ts) AS timestamp_utc,
         CASE WHEN k % 23 = 0 OR k % 29 = 0 OR k % 31 = 0 THEN CAST(1 AS DECIMAL(10,4))
              ELSE CAST(value / 10 AS DECIMAL(10,4)) END AS work_unit,
         CAST(1 AS BIGINT) AS raw_count,
         ftype, campaign_dir
  FROM csv_base WHERE ftype < 4 AND NOT bad_ts""", "csv_base")

cte("csv_keyed", """
  SELECT *, sha256(concat_ws('|', CAST(event_id AS VARCHAR), CAST(source_id AS VARCHAR), source_guid,
                   strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S+00:00'), center, COALESCE(project, ''))) AS dedupe_key
  FROM csv_records""", "csv_records")

ORACLE["s2_csv_files"] = sql("""
SELECT DISTINCT campaign_dir,
       ['final-digItems.csv', 'final-sitcItems.csv', 'ddf.csv', 'n4Items.csv'][ftype + 1] AS file_name
FROM csv_base WHERE ftype < 4""", "csv_base")
ORACLE["n13_csv_records"] = sql(f"SELECT {_FEED_COLS} FROM csv_keyed", "csv_keyed")
ORACLE["n10_csv_header_forms"] = sql("SELECT source_guid, description FROM csv_records WHERE ftype = 2", "csv_records")
ORACLE["n11_csv_filled"] = sql("SELECT source_guid, project FROM csv_records", "csv_records")
ORACLE["n12_csv_numeric"] = sql("""
SELECT source_guid, CAST(work_unit AS DOUBLE) AS work_unit, raw_count FROM csv_records""", "csv_records")
ORACLE["n14_csv_source"] = sql("SELECT source_guid, source_id FROM csv_records", "csv_records")
ORACLE["n15_csv_center"] = sql("SELECT source_guid, center FROM csv_records", "csv_records")
ORACLE["a10_import_stats"] = sql("""
SELECT campaign_dir, count(DISTINCT ftype) AS files, count(*) AS rows_read,
       count(*) FILTER (WHERE NOT bad_ts) AS records, count(*) FILTER (WHERE bad_ts) AS rejected,
       CAST(NULL AS VARCHAR) AS note
FROM csv_base WHERE ftype < 4 GROUP BY campaign_dir""", "csv_base")


# --- sinks, streaming ------------------------------------------------------------------

ORACLE["s4_chart_series"] = sql(f"""
SELECT p.event_id, p.slug AS event, {NOW} AS generated_at, p.is_live, 'weighted' AS metric_mode, p.bucket_size,
       s.center, strftime(s.bucket, '%Y-%m-%dT%H:%M:%S+00:00') AS hour,
       CAST(s.weighted AS DOUBLE) AS weighted, CAST(s.cumulative_weighted AS DOUBLE) AS cumulative_weighted,
       s.raw, s.cumulative_raw
FROM plan p JOIN center_series s ON s.event_id = p.event_id""", "plan", "center_series")

ORACLE["s5_snapshots"] = sql(f"""
WITH elig AS (SELECT event_id FROM campaigns WHERE is_archived AND NOT is_live AND is_public),
prior AS (
  SELECT event_id, 'hourly' AS snapshot_type,
         {NOW} - to_seconds(CASE event_id WHEN 0 THEN 600 WHEN 1 THEN 1200 ELSE 60 END) AS generated_at
  FROM campaigns WHERE event_id IN (0, 1, 4)),
keep AS (
  SELECT * FROM prior WHERE event_id IN (SELECT event_id FROM elig)
    AND generated_at > {NOW} - INTERVAL 900 SECOND),
fresh AS (
  SELECT event_id, 'hourly' AS snapshot_type, count(*) AS points FROM per_bucket
  WHERE event_id IN (SELECT event_id FROM elig) GROUP BY event_id
  UNION ALL
  SELECT event_id, 'by_center', count(*) FROM center_series
  WHERE event_id IN (SELECT event_id FROM elig) GROUP BY event_id)
SELECT event_id, snapshot_type, generated_at, CAST(NULL AS BIGINT) AS points FROM keep
UNION ALL
SELECT f.event_id, f.snapshot_type, {NOW}, f.points FROM fresh f
WHERE NOT EXISTS (SELECT 1 FROM keep k WHERE k.event_id = f.event_id AND k.snapshot_type = f.snapshot_type)""",
    "campaigns", "per_bucket", "center_series")

ORACLE["r1_stream_ingest"] = sql(f"SELECT {_FEED_COLS} FROM feed_keyed", "feed_keyed")

ORACLE["r1_stream_checkpoints"] = sql(f"""
SELECT event_id, source_id, max(timestamp_utc) AS last_seen_timestamp, 'ok' AS last_status, {NOW} AS last_run_at
FROM feed_records GROUP BY event_id, source_id""", "feed_records")

ORACLE["r3_replay_idempotent"] = sql("""
SELECT k.dedupe_key, CAST(k.work_unit AS DOUBLE) AS work_unit, k.raw_count,
       TIMESTAMP '2024-02-01 00:00:00' + to_minutes(CAST(floor(CAST(k.source_guid_num AS BIGINT) / 100) AS BIGINT))
         AS created_at
FROM (SELECT *, regexp_replace(source_guid, '^g-', '') AS source_guid_num FROM feed_keyed) k""", "feed_keyed")

ORACLE["r4_late_data_rollup"] = sql("""
SELECT event_id, date_trunc('hour', timestamp_utc) AS bucket_hour_utc, center,
       CAST(SUM(work_unit) AS DOUBLE) AS weighted_sum, CAST(SUM(raw_count) AS BIGINT) AS raw_sum
FROM feed_records GROUP BY ALL""", "feed_records")

ORACLE["r2_tumbling_windows"] = sql("""
SELECT event_id, date_trunc('hour', timestamp_utc) AS bucket, center,
       CAST(SUM(work_unit) AS DOUBLE) AS weighted, CAST(SUM(raw_count) AS BIGINT) AS raw
FROM feed_records GROUP BY ALL""", "feed_records")

ORACLE["s3_store_roundtrip"] = sql("""
SELECT dedupe_key, event_id, center, timestamp_utc, CAST(work_unit AS DOUBLE) AS work_unit,
       CAST(raw_count AS BIGINT) AS raw_count
FROM records WHERE event_id IN (1, 3)""", "records")

ORACLE["w9_time_axis"] = sql("""
SELECT r.dedupe_key, CASE WHEN c.is_live THEN r.created_at ELSE r.timestamp_utc END AS chart_ts
FROM records r JOIN campaigns c ON r.event_id = c.event_id""", "records", "campaigns")


def _project(key: str, cols: str) -> str:
    return f"SELECT {cols} FROM ({ORACLE[key]})"


ORACLE["n18_display_name"] = _project("n17_n19_campaign_labels", "event_id, display_name")
ORACLE["n19_report_label"] = _project("n17_n19_campaign_labels", "event_id, report_label")

ORACLE["j10_delete_impact"] = sql("""
SELECT 'records' AS "table", event_id, count(*) AS n FROM records WHERE event_id = 2 GROUP BY event_id
UNION ALL SELECT 'rollup', event_id, count(*) FROM rollup WHERE event_id = 2 GROUP BY event_id
UNION ALL SELECT 'checkpoints', event_id, count(*) FROM checkpoints WHERE event_id = 2 GROUP BY event_id
UNION ALL SELECT 'bridge', event_id, count(*) FROM bridge WHERE event_id = 2 GROUP BY event_id""",
    "records", "rollup", "checkpoints", "bridge")

ORACLE["t5_embed_target"] = sql("""
SELECT c.event_id, c.slug, EXISTS (SELECT 1 FROM records r WHERE r.event_id = c.event_id) AS has_data
FROM (SELECT * FROM campaigns WHERE is_live AND is_public ORDER BY event_id LIMIT 1) c""", "campaigns", "records")

ORACLE["t2_public_index"] = sql("""
SELECT c.event_id, c.slug, c.starts_at,
       (SELECT count(*) FROM records r WHERE r.event_id = c.event_id) AS records_count,
       row_number() OVER (ORDER BY c.starts_at DESC, c.event_id) AS position
FROM campaigns c WHERE c.is_public""", "campaigns", "records")

ORACLE["r5_token_walk"] = sql("""
WITH RECURSIVE n AS (
  SELECT p.event_id, p.source_id, p.page_offset, i.items_read, p.kept AS items_kept,
         CASE WHEN p.page_offset = 0 THEN ''
              WHEN p.adapter_type = 'api_json' THEN left(sha256(concat_ws('|', p.event_id, p.source_id, p.page_offset)), 16)
              ELSE CAST(p.page_offset * 100 AS VARCHAR) END AS token,
         CASE WHEN p.adapter_type = 'api_json' THEN CASE WHEN p.page_offset < p.last_page
                THEN left(sha256(concat_ws('|', p.event_id, p.source_id, p.page_offset + 1)), 16) END
              WHEN p.adapter_type = 'biospex_json' THEN CASE WHEN p.page_offset * 100 + 100 < p.num_found
                THEN CAST(p.page_offset * 100 + 100 AS VARCHAR) END
              WHEN p.kept >= 100 THEN CAST(p.page_offset * 100 + p.kept AS VARCHAR) END AS next
  FROM faulty_pages p JOIN (
    SELECT event_id, source_id, page_offset, count(*) AS items_read FROM feed_items GROUP BY event_id, source_id, page_offset) i
    ON p.event_id = i.event_id AND p.source_id = i.source_id AND p.page_offset = i.page_offset
  WHERE (p.event_id + p.source_id + p.page_offset) % 29 <> 17),
w AS (
  SELECT event_id, source_id, token, next FROM n WHERE token = ''
  UNION ALL
  SELECT n.event_id, n.source_id, n.token, n.next
  FROM w JOIN n ON n.event_id = w.event_id AND n.source_id = w.source_id AND n.token = w.next)
SELECT n.event_id, n.source_id, n.token, n.page_offset, CASE WHEN w.token IS NULL THEN 'unreachable' ELSE 'reached' END AS status,
       n.items_read, n.items_kept
FROM n LEFT JOIN w ON n.event_id = w.event_id AND n.source_id = w.source_id AND n.token = w.token
UNION ALL
SELECT w.event_id, w.source_id, w.next, NULL, 'missing', NULL, NULL
FROM w LEFT JOIN n ON n.event_id = w.event_id AND n.source_id = w.source_id AND n.token = w.next
WHERE w.next IS NOT NULL AND n.token IS NULL""", "faulty_pages", "feed_items")

ORACLE["r2_deduplicated_windows"] = ORACLE["r2_tumbling_windows"]
ORACLE["r2_changed_windows"] = sql("""
WITH p AS (
  SELECT event_id, date_trunc('hour', timestamp_utc) AS bucket, center,
         floor(CAST(regexp_extract(source_guid, '[0-9]+') AS BIGINT) / 100) >= 60 AS late
  FROM feed_records)
SELECT CAST(late AS BIGINT) AS batch, count(DISTINCT (event_id, bucket, center)) AS windows FROM p GROUP BY late""", "feed_records")

ORACLE["j10_persisted_delete"] = sql("""
WITH r AS (SELECT * FROM records WHERE event_id <> 2 AND source_id <> 7)
SELECT count(*) AS n_rows, 'records' AS table_name FROM r
UNION ALL SELECT count(*), 'rollup' FROM (SELECT DISTINCT event_id, date_trunc('hour', timestamp_utc), center FROM r)
UNION ALL SELECT count(*), 'checkpoints' FROM checkpoints WHERE event_id <> 2 AND source_id <> 7
UNION ALL SELECT count(*), 'bridge' FROM bridge WHERE event_id <> 2 AND source_id <> 7
UNION ALL SELECT count(*), 'campaigns' FROM campaigns WHERE event_id <> 2
UNION ALL SELECT count(*), 'sources' FROM sources WHERE source_id <> 7""", "records", "checkpoints", "bridge", "campaigns", "sources")

ORACLE["q345_form_rules"] = sql("""
WITH c AS (
  SELECT v * 100 + event_id AS event_id, CASE v WHEN 1 THEN 1999 WHEN 2 THEN NULL ELSE year END AS year,
         CASE v WHEN 3 THEN '' WHEN 4 THEN 'winter' ELSE season END AS season,
         CASE v WHEN 5 THEN NULL WHEN 6 THEN repeat('x', 256) WHEN 12 THEN ' ' ELSE slug END AS slug,
         CASE v WHEN 7 THEN repeat('x', 300) ELSE display_alias END AS display_alias,
         CASE WHEN v <> 8 THEN starts_at END AS starts_at,
         CASE v WHEN 9 THEN NULL WHEN 10 THEN starts_at WHEN 11 THEN ends_at + INTERVAL 366 DAY ELSE ends_at END AS ends_at
  FROM campaigns, (SELECT unnest(range(0, 13)) AS v)),
s AS (
  SELECT v * 100 + source_id AS source_id, CASE v WHEN 1 THEN '  ' WHEN 2 THEN repeat('x', 256) ELSE name END AS name,
         CASE v WHEN 3 THEN NULL WHEN 4 THEN repeat('x', 256) ELSE slug END AS slug,
         CASE v WHEN 5 THEN NULL WHEN 6 THEN 'ftp_csv' ELSE adapter_type END AS adapter_type,
         CASE v WHEN 7 THEN 'not a url' WHEN 8 THEN 'https://' || repeat('x', 500) WHEN 9 THEN 'https://example.org/feed?x=1' ELSE base_url END AS base_url
  FROM sources, (SELECT unnest(range(0, 10)) AS v))
SELECT rule, 'campaigns' AS table_name, CAST(event_id AS VARCHAR) AS row_key, detail FROM (
  SELECT 'Q3' AS rule, event_id, 'start year differs from campaign year' AS detail FROM c WHERE year(starts_at) <> year
  UNION ALL SELECT 'Q3', event_id, 'end year differs from campaign year' FROM c WHERE year(ends_at) <> year
  UNION ALL SELECT 'Q3', event_id, 'end not in the start year' FROM c WHERE year(ends_at) <> year(starts_at)
  UNION ALL SELECT 'Q3', event_id, 'end not after start' FROM c WHERE ends_at <= starts_at
  UNION ALL SELECT 'Q4', event_id, 'missing year' FROM c WHERE year IS NULL
  UNION ALL SELECT 'Q4', event_id, 'year outside 2000-2100' FROM c WHERE year < 2000 OR year > 2100
  UNION ALL SELECT 'Q4', event_id, 'missing season' FROM c WHERE coalesce(trim(season), '') = ''
  UNION ALL SELECT 'Q4', event_id, 'missing slug' FROM c WHERE coalesce(trim(slug), '') = ''
  UNION ALL SELECT 'Q4', event_id, 'slug longer than 255' FROM c WHERE length(slug) > 255
  UNION ALL SELECT 'Q4', event_id, 'display alias longer than 255' FROM c WHERE length(display_alias) > 255
  UNION ALL SELECT 'Q4', event_id, 'missing start' FROM c WHERE starts_at IS NULL
  UNION ALL SELECT 'Q4', event_id, 'missing end' FROM c WHERE ends_at IS NULL
  UNION ALL SELECT 'Q5', event_id, 'season not allowed' FROM c WHERE coalesce(trim(season), '') <> '' AND season NOT IN ('spring', 'fall'))
UNION ALL
SELECT rule, 'sources', CAST(source_id AS VARCHAR), detail FROM (
  SELECT 'Q4' AS rule, source_id, 'missing name' AS detail FROM s WHERE coalesce(trim(name), '') = ''
  UNION ALL SELECT 'Q4', source_id, 'name longer than 255' FROM s WHERE length(name) > 255
  UNION ALL SELECT 'Q4', source_id, 'missing slug' FROM s WHERE coalesce(trim(slug), '') = ''
  UNION ALL SELECT 'Q4', source_id, 'slug longer than 255' FROM s WHERE length(slug) > 255
  UNION ALL SELECT 'Q4', source_id, 'missing adapter type' FROM s WHERE coalesce(trim(adapter_type), '') = ''
  UNION ALL SELECT 'Q4', source_id, 'base url longer than 500' FROM s WHERE length(base_url) > 500
  UNION ALL SELECT 'Q4', source_id, 'base url is no url' FROM s
   WHERE coalesce(trim(base_url), '') <> '' AND NOT regexp_matches(base_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^[:space:]/?#]+([/?#][^[:space:]]*)?$')
  UNION ALL SELECT 'Q5', source_id, 'adapter type not allowed' FROM s
   WHERE coalesce(trim(adapter_type), '') <> '' AND adapter_type NOT IN ('api_json', 'http_json', 'biospex_json', 'digivol_json'))""",
    "campaigns", "sources")

ORACLE["m5_stored_sources"] = sql("""
WITH d(slug, name, adapter_type, supports_weighting, is_active, weight_field, base_url, notes) AS (VALUES
  ('digivol', 'DigiVol', 'digivol_json', FALSE, TRUE, NULL, 'http://volunteer.ala.org.au/ws/transcriptionFeed.json', NULL),
  ('les-herbonautes', 'Les Herbonautes', 'api_json', TRUE, FALSE, 'discretionaryState.workUnit',
   'http://lesherbonautes.mnhn.fr/contributions/interval/json', NULL),
  ('smithsonian', 'Smithsonian Transcription Center', 'api_json', FALSE, FALSE, NULL, NULL, 'notes only'),
  ('notes-from-nature', 'Notes From Nature (BioSpex)', 'biospex_json', FALSE, TRUE, NULL, NULL, NULL),
  ('doedat', 'DoeDat', 'api_json', FALSE, FALSE, NULL, 'https://www.doedat.be/ws/transcriptionFeed.json', NULL),
  ('citsciscribe', 'CitSciScribe', 'api_json', FALSE, FALSE, NULL, 'https://example.org/citsci', 'passed by the deployment')),
n AS (SELECT *, CAST(ascii(slug) + length(slug) * 200 AS BIGINT) AS source_id FROM d WHERE slug <> 'doedat'),
o AS (
  SELECT source_id, name, slug, base_url, adapter_type, supports_weighting, weight_field, is_active, notes FROM sources
  UNION ALL
  SELECT source_id, CASE WHEN source_id % 2 = 0 THEN '' ELSE 'Own ' || name END, slug,
         CASE WHEN source_id % 3 = 0 THEN 'https://example.org/own' END, CASE WHEN source_id % 5 = 0 THEN '' ELSE 'http_json' END,
         NOT supports_weighting, CASE WHEN source_id % 2 = 1 THEN '' END, FALSE, CASE WHEN source_id % 2 = 0 THEN '' ELSE 'own notes' END
  FROM n)
SELECT CASE WHEN o.slug IS NULL
            THEN (SELECT max(source_id) FROM o) + row_number() OVER (PARTITION BY o.slug IS NULL ORDER BY d.slug)
            ELSE o.source_id END AS source_id,
       COALESCE(o.slug, d.slug) AS slug, COALESCE(NULLIF(o.name, ''), d.name) AS name,
       COALESCE(NULLIF(o.adapter_type, ''), d.adapter_type) AS adapter_type,
       CASE WHEN o.slug IS NULL THEN d.supports_weighting ELSE o.supports_weighting END AS supports_weighting,
       CASE WHEN o.slug IS NULL THEN d.is_active ELSE o.is_active END AS is_active,
       COALESCE(NULLIF(o.weight_field, ''), CAST(d.weight_field AS VARCHAR)) AS weight_field,
       COALESCE(NULLIF(o.base_url, ''), CAST(d.base_url AS VARCHAR)) AS base_url, COALESCE(NULLIF(o.notes, ''), CAST(d.notes AS VARCHAR)) AS notes
FROM o FULL OUTER JOIN d ON o.slug = d.slug""", "sources")

ORACLE["t1_record_order_large"] = sql("""
SELECT event_id, center, timestamp_utc, dedupe_key,
       row_number() OVER (PARTITION BY event_id ORDER BY center, timestamp_utc, dedupe_key) AS position
FROM records_large""", "records_large")

ORACLE["w4_padded_series"] = sql("""
WITH p AS (
  SELECT event_id, CAST(CAST(floor(CAST(source_guid AS BIGINT) / 8) AS BIGINT) AS VARCHAR) AS center, date_trunc('hour', timestamp_utc) AS bucket,
         sum(work_unit) AS weighted, CAST(sum(raw_count) AS BIGINT) AS raw
  FROM records GROUP BY ALL),
s AS (
  SELECT *, sum(weighted) OVER w AS cumulative_weighted, CAST(sum(raw) OVER w AS BIGINT) AS cumulative_raw,
         count(*) OVER (PARTITION BY event_id, center) AS n
  FROM p WINDOW w AS (PARTITION BY event_id, center ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, center, bucket, CAST(weighted AS DOUBLE) AS weighted, raw, CAST(cumulative_weighted AS DOUBLE) AS cumulative_weighted, cumulative_raw
FROM s
UNION ALL
SELECT event_id, center, bucket - INTERVAL 1 HOUR, 0, 0, 0, 0 FROM s WHERE n = 1""", "records")

ORACLE["s4_document_points"] = sql("""
SELECT event_id, center, CAST(floor(n / 40) AS BIGINT) AS part, n % 40 AS place, strftime(bucket, '%Y-%m-%dT%H:%M:%S+00:00') AS hour,
       CAST(weighted AS DOUBLE) AS weighted, CAST(cumulative_weighted AS DOUBLE) AS cumulative_weighted, raw, cumulative_raw
FROM (SELECT *, row_number() OVER (PARTITION BY event_id, center ORDER BY bucket) - 1 AS n FROM center_series)""", "center_series")

ORACLE["s5_snapshot_points"] = sql("""
WITH elig AS (SELECT event_id FROM campaigns WHERE is_archived AND NOT is_live AND is_public)
SELECT event_id, snapshot_type, CAST(floor(n / 40) AS BIGINT) AS part, bucket, center, CAST(weighted AS DOUBLE) AS weighted, raw FROM (
  SELECT event_id, 'hourly' AS snapshot_type, bucket, CAST(NULL AS VARCHAR) AS center, weighted, raw,
         row_number() OVER (PARTITION BY event_id ORDER BY bucket) - 1 AS n
  FROM per_bucket WHERE event_id IN (SELECT event_id FROM elig)
  UNION ALL
  SELECT event_id, 'by_center', bucket, center, weighted, raw, row_number() OVER (PARTITION BY event_id ORDER BY bucket, center) - 1
  FROM center_series WHERE event_id IN (SELECT event_id FROM elig))""", "campaigns", "per_bucket", "center_series")

ORACLE["n10_csv_file_forms"] = sql("""
SELECT ['final-digItems.csv', 'final-sitcItems.csv', 'ddf.csv', 'n4Items.csv'][ftype + 1] AS file_name, source_guid, description
FROM csv_records""", "csv_records")

ORACLE["s3_whole_store"] = sql("""
SELECT dedupe_key, event_id, center, timestamp_utc, CAST(work_unit AS DOUBLE) AS work_unit, CAST(raw_count AS BIGINT) AS raw_count
FROM records""", "records")

ORACLE["f7_quiet_campaigns"] = sql("""
SELECT event_id FROM campaigns WHERE event_id IN (SELECT event_id FROM checkpoints) AND event_id * 3 <= 5""", "campaigns", "checkpoints")

ORACLE["j5_some_with_records"] = sql("""
SELECT event_id, slug FROM camp_plus c WHERE EXISTS (SELECT 1 FROM records r WHERE r.event_id = c.event_id)""", "camp_plus", "records")
