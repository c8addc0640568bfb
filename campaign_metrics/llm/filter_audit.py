"""Filter interaction audit: what every filter removes at every step of every order, by wide packed counters.

A document's fate in all orders follows from the set of filters that it fails, a mask. So the documents of a part are first
counted by mask (at most 2 to the number of filters, combined map-side). Every mask stands for one big integer whose
64-bit fields hold its outcomes, 1 or 0, at all (order, step) pairs: 600 fields for five filters. The integers of a part,
each times the count of its mask, are summed, and the sum's fields are unpacked into the counts of all steps at once. A
field never overflows into the next: it holds at most the number of documents of the part.

Filters: words are the maximal runs of other characters than ASCII white space, case-sensitive. A: fewer than 200 words.
B: the distinct words are less than half of the words. C: over 3 percent of the code points are A-Z. D: one of ``#$%&*|``.
E: the text is that of a smaller doc_id, anywhere in the table.

Copies are found by digest: the least id of each digest is one aggregate, and rows meet it by (digest, id), so a large
group of copies is spread over tasks.

Defined cases: a null text is empty, and a copy of empty ones; a null id is never a copy, nor is another row a copy of it;
repeated rows count one by one and are no copies of each other (their ids are equal); a document with several labels is
good or toxic if one of them says so; a null part is the empty string; further columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_metrics.llm.tables import text_bytes, written

FILTERS = "ABCDE"
FIELD = 8  # bytes
LEAST_WORDS = 200
CHUNK = 1 << 20  # bytes of a text whose words are listed at a time

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))
_SIGNS = b"#$%&*|"

AUDIT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
         "good_lost bigint, toxic_lost bigint, shapley bigint")


def _word_lists(text: bytes, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text, a chunk at a time; chunks end at white space."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + chunk)
        end = m.start() if m else len(text)
        yield text[at:end].split()
        at = end


def text_mask(text: bytes) -> int:
    """Filters A to D that a UTF-8 text fails, as bits 0 to 3."""
    words, distinct = 0, set()
    for some in _word_lists(text):
        words += len(some)
        distinct.update(some)
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUED))
    signs = len(text) != len(text.translate(None, _SIGNS))
    return (words < LEAST_WORDS) | (100 * len(distinct) < 50 * words) << 1 | (100 * upper > 3 * points) << 2 | signs << 3


def _mask_and_digest(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"mask": [text_mask(t) for t in texts], "digest": [hashlib.sha256(t).digest() for t in texts]})


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Documents by part and mask of failed filters: part, mask, docs, good, toxic (counts)."""
    judge = F.pandas_udf(_mask_and_digest, "mask int, digest binary")
    marked = written(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                    judge(text_bytes()).alias("m")).select("doc_id", "part", "m.mask", "m.digest"), "filter-masks")
    rows = marked.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    least = marked.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    labelled = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    copy = F.col("least").isNull() & F.col("doc_id").isNotNull()
    full = (rows.join(least, ["doc_id", "digest"], "left").join(labelled, "doc_id", "left")
            .withColumn("mask", F.col("mask") + F.when(copy, 16).otherwise(0)))
    return full.groupBy("part", "mask").agg(
        F.sum("n").alias("docs"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic"))


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def packed_outcomes(filters: str = FILTERS) -> tuple[list[int], list[int]]:
    """For every mask two integers with a field for each order and step: removed there; failing there, but removed before."""
    removed, redundant = [], []
    for mask in range(1 << len(filters)):
        here, late, field = 0, 0, 0
        for order in orders(filters):
            gone = False
            for letter in order:
                if mask >> filters.index(letter) & 1:
                    if gone:
                        late |= 1 << field
                    else:
                        here |= 1 << field
                    gone = True
                field += 8 * FIELD
        removed.append(here)
        redundant.append(late)
    return removed, redundant


def unpack(total: int, fields: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(fields * FIELD, "little"), dtype="<i8")


def audit_of(part: str, counts: pd.DataFrame, filters: str = FILTERS) -> pd.DataFrame:
    """All orders and steps of one part from its counts by mask."""
    removed, redundant = packed_outcomes(filters)
    every, steps = orders(filters), len(filters)
    rows = list(zip(counts["mask"].tolist(), counts["docs"].tolist(), counts["good"].tolist(), counts["toxic"].tolist()))

    def summed(outcomes: list[int], column: int) -> np.ndarray:
        return unpack(sum(r[column] * outcomes[r[0]] for r in rows), len(every) * steps)

    gone = summed(removed, 1)
    letter = np.array([filters.index(x) for order in every for x in order])
    alone = np.array([sum(r[1] for r in rows if r[0] == 1 << k) for k in range(steps)])
    kept = sum(r[1] for r in rows) - np.cumsum(gone.reshape(-1, steps), axis=1).ravel()
    shapley = np.zeros(steps, dtype=np.int64)
    np.add.at(shapley, letter, gone)
    return pd.DataFrame({
        "part": part, "filter_order": np.repeat(every, steps), "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), len(every)),
        "kept": kept, "removed": gone, "redundant": summed(redundant, 1), "unique_fails": alone[letter],
        "good_lost": summed(removed, 2), "toxic_lost": summed(removed, 3), "shapley": shapley[letter]})


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. ``docs`` has doc_id, text and the column ``part``; ``labels`` has doc_id, quality and toxic."""
    def audit(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        return audit_of(key[0], counts)

    return masks(docs, labels, part).groupBy("part").applyInPandas(audit, AUDIT)
