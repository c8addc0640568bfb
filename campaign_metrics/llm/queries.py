"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaign_metrics.llm.chat import chat_digest, chat_windows
from campaign_metrics.llm.decontaminate import contamination
from campaign_metrics.llm.filter_audit import audit_filters
from campaign_metrics.llm.html_text import extract_pages
from campaign_metrics.llm.language import fit_language, predict_language
from campaign_metrics.llm.nnls_packing import pack_by_histogram
from campaign_metrics.llm.packing import pack
from campaign_metrics.llm.quality import fit_quality, judge_quality
from campaign_metrics.llm.secret_scan import scan_secrets
from campaign_metrics.llm.simhash import near_duplicate_classes
from campaign_metrics.llm.sketch_search import search
from campaign_metrics.llm.tables import table
from campaign_metrics.llm.token_counts import TokenRollup, roll_up_documents, roll_up_rows
from campaign_metrics.llm.url_rules import UrlRule, judge_urls
from campaign_metrics.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

URL_RULES = [
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
]


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@register
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@register
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


@register
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), *document_owner())


def document_owner():
    """Owner and repository of a document: its source, and its source's part in one language."""
    return F.col("source"), F.concat_ws("/", "source", "lang")


@register
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@register
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


@register
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more whose texts hold control strings."""
    odd = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return chat_digest(chat_windows(turns.unionByName(more)))


@register
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_language(docs, fit_language(docs))


@register
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all rows, after inserts, revised counts, copies deleted and inserted again, and second deliveries."""
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    roll_up_rows(rollup, table(spark, sf_dir, "documents"), withdraw=True)
    return rollup.totals()


@register
def op10_token_counts_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of distinct texts, after inserts, revised counts, deletes of copies and a second delivery."""
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    roll_up_documents(rollup, table(spark, sf_dir, "documents"))
    return rollup.totals()


@register
def op10_token_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all rows, copies included, after inserts, revised counts and a second delivery."""
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    roll_up_rows(rollup, table(spark, sf_dir, "documents"))
    return rollup.totals()


@register
def op11_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op13_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_histogram(table(spark, sf_dir, "documents"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op5_benchmark_decontamination"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
il AS (SELECT item_id, w, least(10, len(w)) AS size FROM i WHERE len(w) > 0),
iw AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS win
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM il)),
dw AS (
  SELECT doc_id, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
h AS (SELECT dw.doc_id, dw.p, dw.size, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
c AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM (SELECT DISTINCT doc_id, p, size FROM h)) GROUP BY doc_id),
s AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""

ORACLE["op6_url_filters"] = rf"""
WITH p AS (
  SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT p.page_id, p.host, p.path, first(rhost || rpath ORDER BY length(rhost) DESC, length(rpath) DESC) AS rule,
         first(v ORDER BY length(rhost) DESC, length(rpath) DESC) AS v
  FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND p.host = m.host AND p.path = m.path
"""

_ASSIGN = """(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _kind_sql(kind: int, pattern: str, keep: str) -> str:
    """Matches of one kind with positions: the pieces between them and the matches add up."""
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
SELECT r, {kind} AS kind, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, value FROM (
  SELECT r, hit, value, sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
    SELECT r, unnest(range(1, len(hits) + 1)) AS i, unnest(list_slice(gaps, 1, len(hits))) AS gap, unnest(hits) AS hit, unnest(vals) AS value
    FROM (SELECT r, string_split_regex(text, {quoted}) AS gaps, regexp_extract_all(text, {quoted}, 0) AS hits,
                 regexp_extract_all(text, {quoted}, 2) AS vals FROM d WHERE regexp_matches(text, {quoted})))) WHERE {keep}"""


ORACLE["op4_secret_scans"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo
  FROM documents),
b AS ({_kind_sql(0, _ASSIGN, "length(value) >= 8")} UNION ALL {_kind_sql(1, "()(AKIA[A-Z0-9]{12,})", "true")}
  UNION ALL {_kind_sql(2, "()([0-9a-f]{32,})", "true")}),
t AS (
  SELECT * FROM ({_kind_sql(3, "()([A-Za-z0-9+/_=-]{20,})", "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')")}) t
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = t.r AND b.s < t.e AND t.s < b.e)),
a AS (SELECT * FROM b UNION ALL SELECT * FROM t),
f AS (
  SELECT value, count(DISTINCT owner) < 3 AND count(DISTINCT (owner, repo)) < 6 AS live FROM a JOIN d ON a.r = d.r GROUP BY value),
j AS (
  SELECT a.*, f.live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e AS word FROM a JOIN f ON a.value = f.value),
g AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(word, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(word, ',' ORDER BY s, kind) FILTER (kind < 3 OR live) AS spans,
         count(*) FILTER (kind = 3 AND live) AS n_owned, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM j GROUP BY r)
SELECT d.doc_id, coalesce(g.n_assign, 0) AS n_assign, coalesce(g.n_access, 0) AS n_access, coalesce(g.n_hex, 0) AS n_hex,
       sha256(coalesce(g.base, '')) AS base_sha256, coalesce(g.spans, '') AS spans, coalesce(g.n_owned, 0) AS n_owned,
       coalesce(g.n_live, 0) AS n_live, coalesce(g.n_example, 0) AS n_example
FROM d LEFT JOIN g ON d.r = g.r
"""

_ESCAPED = r"regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?TURN\])', '\1\\\2\3', 'g')"

ORACLE["op8_chat_formatting"] = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, CAST(ceil(length(text) / 4) AS BIGINT) + 4 AS tokens,
         length({_ESCAPED}) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + length(role) END AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM c),
p AS (
  SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY rn) - tokens AS BIGINT) AS start,
         first_value(CASE WHEN role = 'system' THEN tokens END) OVER (PARTITION BY conv_id ORDER BY rn) AS sys_tokens,
         first_value(CASE WHEN role = 'system' THEN chars END) OVER (PARTITION BY conv_id ORDER BY rn) AS sys_chars FROM t),
b AS (SELECT *, greatest((768 - coalesce(sys_tokens, 0)) // 2, 128) AS stride FROM p),
w AS (SELECT *, 2 * (start // stride) + CAST(tokens > stride AS INTEGER) AS win FROM b),
s AS (
  SELECT conv_id, win, min(start) AS first, sum(chars) AS own, CASE WHEN min(start) > 0 THEN coalesce(max(sys_chars), 0) ELSE 0 END AS opener
  FROM w GROUP BY conv_id, win),
h AS (
  SELECT s.conv_id, s.win, sum(w.chars) AS chars
  FROM s JOIN w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.start < s.first AND w.start >= s.first - 256
       AND NOT (w.start = 0 AND w.sys_chars IS NOT NULL) GROUP BY s.conv_id, s.win),
f AS (
  SELECT s.conv_id, sum(own + opener + coalesce(h.chars, 0)) AS formatted_chars
  FROM s LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM s.conv_id AND h.win = s.win GROUP BY s.conv_id),
d AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn) AS said,
         coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '') AS loss FROM t GROUP BY conv_id)
SELECT d.conv_id, d.n_turns, sha256(d.said) AS turns_sha256, CAST(length(d.loss) AS BIGINT) AS loss_chars, sha256(d.loss) AS loss_sha256,
       CAST(f.formatted_chars AS BIGINT) AS formatted_chars
FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""

ORACLE["op12_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
n AS (
  SELECT part, a, b, c, d, e, count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, a, b, c, d, e),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order FROM f AS f1, f AS f2, f AS f3, f AS f4, f AS f5
  WHERE f2.x <> f1.x AND f3.x NOT IN (f1.x, f2.x) AND f4.x NOT IN (f1.x, f2.x, f3.x) AND f5.x NOT IN (f1.x, f2.x, f3.x, f4.x)),
k AS (
  SELECT *, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
            || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails FROM n),
s AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, docs, good, toxic, fails,
         contains(fails, substr(filter_order, step, 1)) AS here,
         length(translate(substr(filter_order, 1, step - 1), fails, '')) < step - 1 AS gone
  FROM k, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, x, sum(CASE WHEN NOT gone AND NOT here THEN docs ELSE 0 END) AS kept,
         sum(CASE WHEN here AND NOT gone THEN docs ELSE 0 END) AS removed, sum(CASE WHEN here AND gone THEN docs ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = x THEN docs ELSE 0 END) AS unique_fails, sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, x)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""

_TERMS = f"""regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

ORACLE["op11_sketch_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
n AS (SELECT r, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM n) GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, g),
i AS (SELECT row_number() OVER () AS k, item_id, terms FROM (SELECT DISTINCT item_id, text, {_TERMS} AS terms FROM benchmark)),
q AS (SELECT DISTINCT k, item_id, term FROM (SELECT k, item_id, unnest(terms) AS term FROM i)),
m AS (SELECT r, doc_id, 50 + (50 * n * docs) // total AS m FROM n, g),
s AS (
  SELECT q.k, q.item_id, m.r, m.doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * m.m))) AS BIGINT) AS score
  FROM q JOIN t ON q.term = t.term JOIN w ON q.term = w.term JOIN m ON t.r = m.r GROUP BY q.k, q.item_id, m.r, m.doc_id),
o AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""
