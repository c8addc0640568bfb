"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are patterns over whole texts: ``assign`` (a key word, ``:`` or ``=``, a value of 8 or more characters),
``access`` (access key ids) and ``hex`` (long hexadecimal strings). Long mixed tokens are candidates besides. Every
candidate value is hashed and counted by distinct owners and distinct repositories over the whole corpus: a value seen with
``EXAMPLE_OWNERS`` owners or ``EXAMPLE_REPOSITORIES`` repositories is a copied example, any other is specific to its
owner and looks live. Live-looking tokens that no base span covers are added as spans of kind ``owned``.

Counting first reduces rows to distinct (hash, owner, repository) with map-side aggregation, so a value on a third of all
rows is a few rows per task; the hashes then meet their spans in a join whose hot partitions Spark splits. Texts never
move for this: spans, hashes and row numbers do.

Spans count code points, end exclusive. Matches of a kind are leftmost and non-overlapping; matches that fail a length
test are dropped after matching. Defined cases: null text is empty and has no span; a null owner or repository counts
as the empty string; repeated rows are scanned row by row and count once as owner; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaign_metrics.llm.tables import written

KINDS = ["assign", "access", "hex", "owned"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"()(AKIA[A-Z0-9]{12,})"
HEX = r"()([0-9a-f]{32,})"
TOKEN = r"()([A-Za-z0-9+/_=-]{20,})"
ASSIGN_CHARS = 8
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 6
MASK = "[secret]"

_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of ``pattern`` whose group 2, the value, meets ``keep``; the value ends the match.

    The pieces between matches and the matches themselves add up to positions in one fold.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(part["hit"].isNotNull() & keep(part["value"]), F.concat(state["spans"], span))
                        .otherwise(state["spans"]).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
    found = F.aggregate(parts, first, step, lambda state: state["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds by start, then kind."""
    always = lambda value: F.lit(True)
    return F.array_sort(F.concat(
        _spans(text, ASSIGN, 0, lambda value: F.length(value) >= ASSIGN_CHARS),
        _spans(text, ACCESS, 1, always), _spans(text, HEX, 2, always)))


def token_spans(text: Column) -> Column:
    """Long tokens of both letters and digits."""
    return _spans(text, TOKEN, 3, lambda value: value.rlike("[0-9]") & value.rlike("[A-Za-z]"))


def span_text(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _found(docs: DataFrame, owner: Column, repository: Column, row: str, base: str, tokens: str, who: str) -> DataFrame:
    """``docs`` written with a row number, base spans, uncovered tokens, owner and repository."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    uncovered = F.filter(F.col(tokens), lambda t: ~F.exists(F.col(base), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return docs.withColumns({
        row: F.monotonically_increasing_id(), base: base_spans(text), tokens: token_spans(text),
        who: F.struct(plain(owner).alias("owner"), plain(repository).alias("repository")),
    }).withColumn(tokens, uncovered)


def _live(found: DataFrame, row: str, base: str, tokens: str, who: str, owners: int, repositories: int) -> DataFrame:
    """(row, live spans, number of example spans) of every row with candidates."""
    span = F.explode(F.concat(base, tokens)).alias("span")
    seen = found.filter((F.size(base) > 0) | (F.size(tokens) > 0)).select(row, F.col(who).alias("who"), span)
    seen = seen.select(row, "who", "span", F.sha2("span.value", 256).alias("hash"))
    counts = (seen.select("hash", "who.owner", "who.repository").distinct()
              .groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.count_distinct("owner", "repository").alias("repositories")))
    live = (F.col("owners") < owners) & (F.col("repositories") < repositories)
    judged = seen.join(counts, "hash").select(row, "span", live.alias("live"))
    return judged.groupBy(row).agg(
        F.array_sort(F.collect_list(F.when(F.col("live"), F.col("span")))).alias("live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_example"))


def scan_secrets(docs: DataFrame, owner: Column, repository: Column, owners: int = EXAMPLE_OWNERS,
                 repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text and what owner and repository need): counts, base_sha256, spans.

    Also n_owned (added spans), n_live and n_example (all spans by the corpus-wide verdict on their value).
    """
    found = _found(docs.select("doc_id", "text", owner.alias("owner"), repository.alias("repository")),
                   F.col("owner"), F.col("repository"), "row", "base", "tokens", "who")
    found = written(found.select("doc_id", "row", "base", "tokens", "who"), "secrets")
    live = _live(found, "row", "base", "tokens", "who", owners, repositories)
    out = found.join(live, "row", "left").withColumn("owned", F.filter(
        F.coalesce("live", F.array().cast(_SPANS)), lambda s: s["kind"] == 3))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.array_sort(F.concat("base", "owned"))).alias("spans"),
        F.size("owned").cast("bigint").alias("n_owned"),
        F.coalesce(F.size("live"), F.lit(0)).cast("bigint").alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def mask_spans(text: Column, spans: Column) -> Column:
    """``text`` with the value of every span replaced by ``MASK``; overlapping values are masked once."""
    values = F.array_sort(F.transform(spans, lambda s: F.struct(
        (s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"))))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        inside = s["start"] < state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(inside, state["out"]).otherwise(
            F.concat(state["out"], gap, F.lit(MASK))).alias("out"))

    return F.aggregate(values, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))


def mask_secrets(docs: DataFrame, owner: Column, repository: Column, owners: int = EXAMPLE_OWNERS,
                 repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """``docs`` with the values of all base and owned spans masked, ``n_chars`` (if there) counted anew.

    Columns as given; a text without spans stays as it is, null included. Only rows with uncovered tokens wait for the
    corpus-wide counts, so other texts are not shuffled.
    """
    tag = "_".join(docs.columns)  # columns that cannot clash with those of docs
    row, base, tokens, who, live = (f"_{k}_{tag}" for k in ("row", "base", "tokens", "who", "live"))
    found = written(_found(docs, owner, repository, row, base, tokens, who), "secrets-docs")
    verdict = _live(found, row, base, tokens, who, owners, repositories).select(row, F.col("live").alias(live))
    none = F.array().cast(_SPANS)
    alone = found.filter(F.size(tokens) == 0).withColumn(live, none)
    waiting = found.filter(F.size(tokens) > 0).join(verdict, row, "left")
    both = alone.unionByName(waiting).withColumn(live, F.concat(base, F.filter(F.coalesce(live, none), lambda s: s["kind"] == 3)))
    masked = both.withColumn("text", F.when(F.size(live) > 0, mask_spans(F.col("text"), F.col(live))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size(live) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                                   .otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)
