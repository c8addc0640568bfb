"""Feed completeness audits (R5), re-aimed from pagination at landed pages.

``walk_pages`` follows the tokens: from each pair's first page to the page
that its next token names, and on. Pages that the walk does not reach, and
tokens that no landed page answers, come out. Tokens are compared as text, so
opaque ones work like numbers.

``missing_next_pages`` looks one page ahead only, by page numbers. For every
landed page, the page its feed says comes next:
generic: the token at ``next_page_token``, ``meta.next_page_token`` or
``links.next`` (a token that is no number means the page after this one); biospex: ``start + rows`` while below ``numFound`` (defaults
0/100/0); digivol: ``offset + kept`` when a page kept at least 100 items
(D11: the kept count, not the read count, drives it). Offsets are in items;
landed pages are numbered ``offset / page size`` (biospex: the page's own ``rows``). A pair whose expected next
page has not landed is reported: an anti join of the expectations against
the landed (pair, page) keys, both sides partitioned by the pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_metrics.functions.json_paths import variant_first, variant_is_object, variant_path
from campaign_metrics.functions.text import blank
from campaign_metrics.operators.adapters import ADAPTERS, source_columns
from campaign_metrics.operators.pages import PAIR, by_family, judge_pages
from campaign_metrics.schema import FEED_PAGE_SIZE, GENERIC_NEXT_TOKEN_PATHS
from campaign_metrics.session import staged
from campaign_metrics.sources.feeds import family_of, page_items


def expected_next_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Per landed page: its family, items read and kept, and the expected next page.

    Items are counted inside the parsed page: nothing is exploded or shuffled.
    """
    fam, page = F.col("_family"), F.col("_page")
    p = pages.join(source_columns(sources), "source_id", "left").withColumns({
        "_family": family_of(F.col("adapter_type")), "_page": F.try_parse_json("body")})
    p = p.withColumn("_objects", F.filter(page_items(page, fam, strict=False), variant_is_object))
    kept = F.size(F.filter("_objects", lambda v: by_family(fam, lambda name: ADAPTERS[name](v, F.to_json(v))["keep"], "boolean")))
    p = p.withColumns({"items_read": F.greatest(F.coalesce(F.size("_objects"), F.lit(0)), F.lit(0)).cast("long"),
                       "items_kept": F.greatest(F.coalesce(kept, F.lit(0)), F.lit(0)).cast("long")})
    token = variant_first(page, GENERIC_NEXT_TOKEN_PATHS)
    # Pages here are numbered: an opaque or URL token stands for the page after this one.
    generic_next = F.when(~blank(token), F.coalesce(token.try_cast("long"), F.col("page_offset") + 1))
    start, rows, found = (F.coalesce(variant_path(page, c).try_cast("long"), F.lit(d).cast("long"))
                          for c, d in (("start", 0), ("rows", FEED_PAGE_SIZE), ("numFound", 0)))
    biospex_next = F.when(start + rows < found, F.floor((start + rows) / F.nullif(rows, F.lit(0))))
    digivol_next = F.when(F.col("items_kept") >= FEED_PAGE_SIZE,
                          F.floor((F.col("page_offset") * FEED_PAGE_SIZE + F.col("items_kept")) / FEED_PAGE_SIZE))
    nxt = (F.when(fam == "generic", generic_next).when(fam == "biospex", biospex_next)
           .when(fam == "digivol", digivol_next))
    return p.select("event_id", "source_id", "page_offset", "_family", "items_read", "items_kept",
                    nxt.cast("long").alias("expected_next"))


def missing_next_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages whose expected next page has not landed."""
    exp = expected_next_pages(pages, sources).filter(F.col("expected_next").isNotNull())
    landed = pages.select("event_id", "source_id", F.col("page_offset").alias("expected_next"))
    return exp.join(landed, ["event_id", "source_id", "expected_next"], "left_anti").select(
        "event_id", "source_id", "page_offset", "expected_next", "items_read", "items_kept")


def walk_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """event_id, source_id, token, page_offset, status, items_read, items_kept, one row per landed token and per missing one.

    ``status`` is ``reached`` (on the walk from the first page), ``unreachable`` (landed, but no walk leads to it),
    ``quarantined`` (on the walk, but not readable, so the walk ends there) or ``missing`` (named by a page of the walk, not
    landed). Of pages landed more than once the latest fetch counts. Pages of no known source are left out.

    The walk takes steps of doubling length: after round k, all pages within 2 ** k steps are reached, and every page
    knows the one 2 ** k steps ahead. So a chain of a million pages takes twenty rounds of two joins by (pair, token),
    a key that no pair makes hot; a token that leads back ends the walk.
    """
    judged = judge_pages(pages, sources).filter("family is not null")
    last = judged.groupBy(*PAIR, "token").agg(F.max_by(
        F.struct("page_offset", "items_read", "items_kept", F.col("reason").isNotNull().alias("bad"),
                 F.when(F.col("reason").isNull(), F.col("next_token")).alias("next")),
        F.struct("fetched_at", "page_offset")).alias("p"))
    nodes = staged(last.select(*PAIR, "token", "p.*"), "walk-pages")
    ahead = nodes.filter("next is not null").select(*PAIR, "token", "next")
    steps = staged(ahead.join(nodes.select(*PAIR, F.col("token").alias("next")), [*PAIR, "next"], "left_semi")
                   .select(*PAIR, "token", "next"), "walk-steps")
    reached = staged(nodes.filter("token = ''").select(*PAIR, "token"), "walk-reached")
    count = reached.count()
    while True:
        found = reached.join(steps, [*PAIR, "token"]).select(*PAIR, F.col("next").alias("token"))
        reached = staged(reached.unionByName(found).distinct(), "walk-reached")
        before, count = count, reached.count()
        if count == before:
            break
        onward = steps.select(*PAIR, F.col("token").alias("next"), F.col("next").alias("far"))
        steps = staged(steps.join(onward, [*PAIR, "next"]).select(*PAIR, "token", F.col("far").alias("next")), "walk-steps")
    marked = nodes.join(reached.withColumn("_on", F.lit(True)), [*PAIR, "token"], "left")
    status = F.when(F.col("_on").isNull(), "unreachable").when(F.col("bad"), "quarantined").otherwise("reached")
    landed = marked.select(*PAIR, "token", "page_offset", status.alias("status"), "items_read", "items_kept")
    named = marked.filter("_on and next is not null").select(*PAIR, F.col("next").alias("token")).distinct()
    missing = named.join(nodes.select(*PAIR, "token"), [*PAIR, "token"], "left_anti")
    none = F.lit(None).cast("long")
    return landed.unionByName(missing.select(*PAIR, "token", none.alias("page_offset"), F.lit("missing").alias("status"),
                                             none.alias("items_read"), none.alias("items_kept")))
