"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are windows of ``WINDOW`` consecutive benchmark words (a shorter item is one window).
The alphabet is words, numbered by the benchmark's vocabulary: a block is the last two words, ``shift``
tells how far a window may jump when its last block cannot end a pattern, buckets keyed by the last block
select test windows, and direct comparison of all words confirms an occurrence. A word that the benchmark
does not have ends the window before it. Patterns of each length have tables of their own, so a
short item does not shorten the jumps for long ones.

Tables are sorted arrays (about 70 bytes a window and two words of vocabulary), broadcast in shards. A shard is
built from at most about ``SHARD_CHARS`` benchmark characters (checked before anything is collected), and one
whose tables take more than ``SHARD_BYTES``, as measured, is halved until they do not. With more than one shard
the documents pass shard by shard, hits carried along in a written table; a shard is released after its
pass, so a worker holds one at a time.

Defined cases: null text has no words; an item without words has no window; hits count words
once however many windows cover them; items are counted by distinct id, a null id written as
the empty string; repeated rows are searched row by row; empty tables give empty results; columns
of ``docs`` are kept whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import sys
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_metrics.llm.tables import free_name, text_bytes, written

WINDOW = 10
SHARD_CHARS = 8_000_000
SHARD_BYTES = 256 << 20

# A-Z to a-z; every other byte outside 0-9, a-z and the non-ASCII range separates words.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))

HIT_SCHEMA = "n_words bigint, spans array<bigint>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _block_keys(windows: np.ndarray, end: int, block: int) -> np.ndarray:
    """The block before position ``end`` of every window, as one number."""
    last = windows[:, end - 1].astype(np.int64)
    return last if block == 1 else (windows[:, end - 2].astype(np.int64) << 32) + last


class WuManber:
    """Search tables for windows of one length: rows of word numbers, each with the item that it belongs to."""

    def __init__(self, windows: np.ndarray, owners: np.ndarray):
        self.size = size = windows.shape[1]
        self.block = block = min(2, size)
        self.default = size - block + 1
        distinct, which = np.unique(windows, axis=0, return_inverse=True)
        order = np.argsort(_block_keys(distinct, size, block), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.windows = np.ascontiguousarray(distinct[order], dtype=np.int32)
        held = np.unique(np.c_[place[which.ravel()], owners], axis=0)
        self.owners = held[:, 1].astype(np.int32)
        self.owner_at = np.searchsorted(held[:, 0], np.arange(len(order) + 1))
        suffixes, first = np.unique(_block_keys(self.windows, size, block), return_index=True)
        self.suffixes = array("q", suffixes.tobytes())
        self.bucket_at = np.r_[first, len(order)]
        keys, shifts = suffixes, np.zeros(len(suffixes), dtype=np.uint8)
        for end in range(size - 1, block - 1, -1):  # the last place where a block occurs gives the least shift
            more = np.setdiff1d(_block_keys(self.windows, end, block), keys)
            keys, shifts = np.r_[keys, more], np.r_[shifts, np.full(len(more), size - end, dtype=np.uint8)]
        order = np.argsort(keys)
        self.keys, self.shifts = array("q", keys[order].tobytes()), shifts[order].tobytes()

    def nbytes(self) -> int:
        arrays = (self.windows, self.owners, self.owner_at, self.bucket_at)
        return sum(a.nbytes for a in arrays) + 8 * (len(self.suffixes) + len(self.keys)) + len(self.shifts)

    def search(self, words: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(start, owners) of every occurrence in word numbers (-1: not in the vocabulary)."""
        size, two, default, keys, shifts = self.size, self.block == 2, self.default, self.keys, self.shifts
        end, n, count = size, len(words), len(keys)
        while end <= n:
            key = words[end - 1]
            if key < 0:
                end += size
                continue
            if two:
                before = words[end - 2]
                if before < 0:
                    end += default
                    continue
                key += before << 32
            at = bisect_left(keys, key)
            step = shifts[at] if at < count and keys[at] == key else default
            if step:
                end += step
                continue
            bucket = bisect_left(self.suffixes, key)
            low, high = self.bucket_at[bucket], self.bucket_at[bucket + 1]
            start = end - size
            for k in np.flatnonzero((self.windows[low:high] == words[start:end]).all(axis=1)) + low:
                yield start, self.owners[self.owner_at[k]:self.owner_at[k + 1]]
            end += 1


class Tables(NamedTuple):
    vocabulary: dict[bytes, int]
    items: list[str]
    searches: list[WuManber]

    def nbytes(self) -> int:
        words = sys.getsizeof(self.vocabulary) + sum(sys.getsizeof(w) + 32 for w in self.vocabulary)
        return words + sum(map(sys.getsizeof, self.items)) + sum(s.nbytes() for s in self.searches)


def build_tables(items: list[tuple[str, bytes]], window: int = WINDOW) -> Tables:
    vocabulary: dict[bytes, int] = {}
    names = sorted({item for item, _ in items})
    number = {name: k for k, name in enumerate(names)}
    windows: dict[int, list[np.ndarray]] = {}
    owners: dict[int, list[np.ndarray]] = {}
    for item, text in items:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], dtype=np.int32)
        size = min(window, len(ids))
        if size:
            rows = np.lib.stride_tricks.sliding_window_view(ids, size)
            windows.setdefault(size, []).append(rows)
            owners.setdefault(size, []).append(np.full(len(rows), number[item], dtype=np.int32))
    return Tables(vocabulary, names, [WuManber(np.concatenate(rows), np.concatenate(owners[size])) for size, rows in windows.items()])


def find_hits(words: list[bytes], tables: Tables) -> tuple[list[int], list[str]]:
    """Merged covered word spans as a flat list start, end, ...; ids of the items found."""
    known = tables.vocabulary.get
    ids = [known(w, -1) for w in words]
    spans, items = [], set()
    for t in tables.searches:
        for start, found in t.search(ids):
            spans.append((start, start + t.size))
            items.update(found.tolist())
    merged: list[int] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged, [tables.items[k] for k in sorted(items)]


def _search_udf(shared):
    @F.pandas_udf(HIT_SCHEMA)
    def search(texts: pd.Series) -> pd.DataFrame:
        tables, out = shared.value, []
        for text in texts:
            words = words_of(text)
            spans, found = find_hits(words, tables)
            out.append((len(words), spans, found))
        return pd.DataFrame(out, columns=["n_words", "spans", "items"])

    return search


def _digest(spans: pd.Series, items: pd.Series) -> pd.DataFrame:
    out = []
    for flat, found in zip(spans, items):
        covered, last = 0, 0
        pairs = np.asarray(flat, dtype=np.int64).reshape(-1, 2)
        for start, end in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
            covered += max(0, end - max(start, last))
            last = max(last, end)
        ids = sorted(set(found))
        out.append((covered, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), covered > 0))
    return pd.DataFrame(out, columns=["n_hit", "n_items", "items_sha256", "contaminated"])


def benchmark_shards(benchmark: DataFrame, shard_chars: int = SHARD_CHARS):
    """Lists of (item id, text bytes), each of at most about ``shard_chars`` characters."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes().alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_chars))
    for k in range(shards):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k) if shards > 1 else items
        yield [(r.item, bytes(r.text)) for r in part.collect()]


def bounded_tables(items: list[tuple[str, bytes]], window: int, shard_bytes: int) -> Iterator[Tables]:
    """Tables of at most ``shard_bytes`` each (those of a single item may take more)."""
    tables = build_tables(items, window)
    if tables.nbytes() <= shard_bytes or len(items) == 1:
        yield tables
        return
    del tables
    half = len(items) // 2
    yield from bounded_tables(items[:half], window, shard_bytes)
    yield from bounded_tables(items[half:], window, shard_bytes)


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS,
              column: str = "hits", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` plus one struct column: n_words, spans (flat start, end pairs of words) and items."""
    spark = docs.sparkSession
    more = free_name(docs.withColumn(column, F.lit(None)), "_more")
    out = shared = None
    for items in benchmark_shards(benchmark, shard_chars):
        for tables in bounded_tables(items, window, shard_bytes):
            if out is not None:
                out = written(out, "decontaminate")
                shared.unpersist()  # its pass is over
            shared = spark.sparkContext.broadcast(tables)
            found = _search_udf(shared)(text_bytes())
            if out is None:
                out = docs.withColumn(column, found)
            else:
                out = out.withColumn(more, found).withColumn(column, F.struct(
                    F.col(f"{column}.n_words").alias("n_words"),
                    F.concat(f"{column}.spans", f"{more}.spans").alias("spans"),
                    F.concat(f"{column}.items", f"{more}.items").alias("items"))).drop(more)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = with_hits(docs.select("doc_id", "text"), benchmark, window, shard_chars)
    digest = F.pandas_udf(_digest, "n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")
    return hits.select("doc_id", F.col("hits.n_words").alias("n_words"),
                       digest("hits.spans", "hits.items").alias("d")).select("doc_id", "n_words", "d.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; columns as given."""
    name = free_name(docs, "_hits")
    return with_hits(docs, benchmark, window, shard_chars, name).filter(F.size(f"{name}.spans") == 0).drop(name)
