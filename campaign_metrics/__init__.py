"""Campaign activity analytics on Spark.

Landed feed pages and historical CSV exports are mapped into one canonical
record table, de-duplicated with a hashed key, rolled up by hour and center,
and queried as DataFrames (charts, summaries, reports, audits). Batch and
Structured Streaming share the same column expressions and operators.
"""

from campaign_metrics.session import checkpoint_dir, ensure_utc, get_session

__all__ = ["checkpoint_dir", "ensure_utc", "get_session"]
