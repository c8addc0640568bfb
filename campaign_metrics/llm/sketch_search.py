"""Ranked lexical search by hashed max-sketches.

A term's impact in a document grows with its count there and falls with the document's length; a score sums weight times
impact over a query's terms.

1. One pass counts N (documents with a term), L (all terms) and the document frequency of the queries' terms.
2. A second pass takes the documents block by block. A document's sketch has ``WIDTH`` coordinates; every term is hashed
   to one and the coordinate keeps the largest impact. So the coordinate of any term is at least its impact, and the
   weighted sum of a query's coordinates is an upper bound of the score. Bounds come for all queries of a batch and all
   documents of the block by looking up the coordinates of the queries' terms.
3. For each query the documents are rescored exactly in order of falling bound, until the bound is below the
   ``top``-th best score so far, which the task carries from block to block. Documents at that very score are rescored,
   too, so that ties are decided by id.
4. Of the best documents of every task, a window by query and a salt takes the best, and one by query the best of those.

The queries are a stated set. They come in batches of at most about ``BATCH_CHARS`` characters, checked before anything is
collected; each batch takes one pass. A block holds at most ``BLOCK_DOCS`` documents and ends after ``BLOCK_BYTES`` of text.

Defined cases: a null text has no terms; an item without terms, or whose terms no document has, gives no rows; items of
equal id and text are one item, those of equal id and different text are ranked each for itself; repeated documents are
ranked row by row; equal scores are in order of id, null ids last; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campaign_metrics.llm.tables import text_bytes, written

TOP = 50
WIDTH = 8192
BLOCK_DOCS = 512
BLOCK_BYTES = 4 << 20
BATCH_CHARS = 4_000_000
SALTS = 64
RESCORED = 32  # documents of a query that are rescored between two looks at its threshold

# A-Z to a-z; every other byte outside 0-9, a-z and the non-ASCII range separates terms.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))

FOUND = "query bigint, doc_id bigint, score bigint"
COUNTS = "term bigint, docs bigint, terms bigint"
ALL_TERMS = -1  # the row of COUNTS that is about all documents


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def coordinate(term: bytes, width: int) -> int:
    return xxhash.xxh3_64_intdigest(term) % width


def length_norm(n: int, docs: int, terms: int) -> int:
    """A document's m, from its number of terms and those of the table."""
    return 100 - 50 + (50 * n * docs) // terms


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Query(NamedTuple):
    number: int
    terms: list[bytes]
    weights: list[int]


class Block(NamedTuple):
    """Documents whose sketches are in memory at one time."""

    ids: list[int | None]
    counts: list[Counter]
    norms: list[int]
    sketches: np.ndarray  # coordinate by document


def make_block(ids: list[int | None], texts: list[list[bytes]], docs: int, terms: int, width: int) -> Block:
    counts = [Counter(t) for t in texts]
    norms = [length_norm(len(t), docs, terms) for t in texts]
    sizes = np.array([len(c) for c in counts])
    tf = np.fromiter((n for c in counts for n in c.values()), dtype=np.int64, count=int(sizes.sum()))
    at = np.fromiter((coordinate(t, width) for c in counts for t in c), dtype=np.int64, count=len(tf))
    m = np.repeat(np.array(norms, dtype=np.int64), sizes)
    sketches = np.zeros((width, len(counts)))
    np.maximum.at(sketches, (at, np.repeat(np.arange(len(counts)), sizes)), (1_000_000_000 * tf) // (1000 * tf + 20 * m))
    return Block(ids, counts, norms, sketches)


def exact_score(query: Query, counts: Counter, m: int) -> int:
    score = 0
    for t, w in zip(query.terms, query.weights):
        tf = counts.get(t)
        if tf:
            score += w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
    return score


def _order(found: tuple[int | None, int]) -> tuple[int, bool, int]:
    """Best first: highest score, then least id, null ids last."""
    doc_id, score = found
    return -score, doc_id is None, doc_id or 0


class Best:
    """The best ``top`` documents of every query so far."""

    def __init__(self, queries: list[Query], top: int, width: int):
        self.queries, self.top = queries, top
        self.found: list[list[tuple[int | None, int]]] = [[] for _ in queries]
        self.places = [np.array([coordinate(t, width) for t in q.terms], dtype=np.int64) for q in queries]
        self.weights = [np.array(q.weights, dtype=float) for q in queries]
        self.rescored = 0

    def threshold(self, k: int) -> int:
        """Below this score a document cannot come in."""
        return self.found[k][-1][1] if len(self.found[k]) == self.top else 1

    def add(self, block: Block) -> None:
        for k, query in enumerate(self.queries):
            # integers below 2 ** 53 all through: the bounds are exact
            bounds = self.weights[k] @ block.sketches[self.places[k]]
            least = self.threshold(k)
            open_ = np.flatnonzero(bounds >= least)
            open_ = open_[np.argsort(-bounds[open_], kind="stable")]
            for i in range(0, len(open_), RESCORED):
                some = open_[i:i + RESCORED]
                if bounds[some[0]] < least:
                    break
                scores = [(block.ids[d], exact_score(query, block.counts[d], block.norms[d])) for d in some.tolist()]
                self.rescored += len(scores)
                better = [s for s in scores if s[1] >= least]
                if better:
                    self.found[k] = sorted(self.found[k] + better, key=_order)[:self.top]
                    least = self.threshold(k)


def _blocks(batches: Iterator[pa.RecordBatch], docs: int, terms: int, width: int, block_docs: int, block_bytes: int) -> Iterator[Block]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            raw = text.as_buffer().to_pybytes()
            words = terms_of(raw)
            if not words:
                continue
            ids.append(doc_id)
            texts.append(words)
            held += len(raw)
            if len(ids) >= block_docs or held >= block_bytes:
                yield make_block(ids, texts, docs, terms, width)
                ids, texts, held = [], [], 0
    if ids:
        yield make_block(ids, texts, docs, terms, width)


def _count(vocabulary):
    """Per partition: how many documents hold each term of the vocabulary, and how many documents and terms there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value
        held, docs, terms = np.zeros(len(numbers), dtype=np.int64), 0, 0
        for batch in batches:
            for text in batch.column("text"):
                words = terms_of(text.as_buffer().to_pybytes())
                if words:
                    docs += 1
                    terms += len(words)
                    for w in set(words):
                        if (k := numbers.get(w)) is not None:
                            held[k] += 1
        seen = np.flatnonzero(held)
        columns = (np.r_[ALL_TERMS, seen], np.r_[docs, held[seen]], np.r_[terms, np.zeros(len(seen), dtype=np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["term", "docs", "terms"])

    return count


def _search(shared, docs: int, terms: int, top: int, width: int, block_docs: int, block_bytes: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value, top, width)
        for block in _blocks(batches, docs, terms, width, block_docs, block_bytes):
            best.add(block)
        rows = [(q.number, d, s) for q, found in zip(best.queries, best.found) for d, s in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query", "doc_id", "score"])

    return search


def _batches(items: DataFrame, batch_chars: int) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (query number, text), each of at most about ``batch_chars`` characters."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    batches = max(1, math.ceil(total / batch_chars))
    for k in range(batches):
        part = items.filter(F.pmod(F.xxhash64("query"), F.lit(batches)) == k) if batches > 1 else items
        yield [(r.query, bytes(r.text)) for r in part.collect()]


def search(docs: DataFrame, items: DataFrame, top: int = TOP, width: int = WIDTH, block_docs: int = BLOCK_DOCS,
           block_bytes: int = BLOCK_BYTES, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """The ``top`` best documents of every item: item_id, rank, doc_id, score.

    ``docs`` has doc_id and text, ``items`` has item_id and text.
    """
    spark = docs.sparkSession
    asked = written(items.select("item_id", text_bytes().alias("text")).distinct()
                    .withColumn("query", F.monotonically_increasing_id()), "search-items")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    parts = []
    for some in _batches(asked, batch_chars):
        said = [(number, list(dict.fromkeys(terms_of(text)))) for number, text in some]
        vocabulary = {t: k for k, t in enumerate(dict.fromkeys(t for _, ts in said for t in ts))}
        counts = (texts.select("text").mapInArrow(_count(spark.sparkContext.broadcast(vocabulary)), COUNTS)
                  .groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).collect())  # a row for a term of the batch
        held = {r.term: r for r in counts}
        n, length = (held[ALL_TERMS].docs, held[ALL_TERMS].terms) if ALL_TERMS in held else (0, 0)
        queries = []
        for number, ts in said:
            mine = [t for t in ts if vocabulary[t] in held]
            if mine:
                queries.append(Query(number, mine, [weight(held[vocabulary[t]].docs, n) for t in mine]))
        if queries:
            parts.append(texts.mapInArrow(
                _search(spark.sparkContext.broadcast(queries), n, length, top, width, block_docs, block_bytes), FOUND))
    found = parts[0] if parts else spark.createDataFrame([], FOUND)
    for more in parts[1:]:
        found = found.unionByName(more)
    ranked = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    for keys in (["query", "salt"], ["query"]):
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return asked.select("query", "item_id").join(ranked, "query").select("item_id", "rank", "doc_id", "score")
