from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from campaign_metrics.llm import packing
from campaign_metrics.llm.queries import QUERIES
from campaign_metrics.llm.tokens import WordEncoder, public_path

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def pieces_of(tokenizer, text, capacity):
    ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
    return [(k, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes()))
            for k, a in enumerate(range(0, len(ids), capacity))]


def check_packed(rows, docs, capacity):
    """Every piece of every row once; sequences gapless and within capacity; returns their number."""
    tokenizer = Tokenizer.from_file(public_path(packing.TOKENIZER))
    want = sorted(((d, *p) for d, t in docs for p in pieces_of(tokenizer, t, capacity)), key=repr)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("text", [
    "", " \t\n", "The  QUICK brown fox", "don't it's we'll 123 4.5", "á ́b İΣ ẞ", "<|endoftext|> x<|startoftext|>y",
    "\x1c\x1d\x1e\x1f\x85 x y　z", "x" * 5000, "👩‍👩‍👧 ééé", "﻿zero​width", "a\x00b"])
def test_words_alone_have_the_ids_of_the_whole_text(text):
    path = public_path(packing.TOKENIZER)
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(WordEncoder(path)(text.encode()), dtype="<u4").tolist() == want


def test_best_fit_takes_the_tightest_bin():
    lengths = np.array([5, 7, 3, 2, 6, 10, 1])
    bins, offsets, fill = packing.best_fit(lengths, 10)
    assert fill.sum() == lengths.sum() and fill.max() <= 10 and len(fill) == 4
    assert bins[1] == bins[2]  # 7 + 3


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_is_near_the_lower_bound(seed):
    lengths = np.random.default_rng(seed).integers(1, 2048, 3000)
    _, _, fill = packing.best_fit(lengths, 2048)
    assert len(fill) <= 1.03 * -(-lengths.sum() // 2048)


def test_query_packs_everything_tightly(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op2_best_fit_packing"](spark, SMALL)
    assert got.columns == COLUMNS
    rows = got.collect()
    n = check_packed(rows, docs, 2048)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("fan_in,partners,local", [(2, 2, 100_000), (3, 64, 10), (8, 8, 3)])
def test_tree_of_many_partitions(spark, fan_in, partners, local):
    rng = np.random.default_rng(fan_in)
    docs = [(i, " ".join(["word"] * int(rng.integers(0, 90)))) for i in range(500)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, node int, fill string").repartition(37)
    rows = packing.pack(df, capacity=64, slack=1, fan_in=fan_in, partners=partners, local_items=local).collect()
    n = check_packed(rows, docs, 64)
    whole = best = -(-sum(r.length for r in rows) // 64)
    assert n <= 1.25 * whole and best <= n


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (2, ""), (None, "nameless"), (3, "long text " * 30000), (4, "x" * 20000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.pack(df).collect()
    check_packed(rows, docs, 2048)
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.pack(df.filter("doc_id = 1")).collect()[0].length == 1


def test_lengths_clustered_by_partition_are_mixed(spark):
    docs = [(i, " ".join(["word"] * (34 if i < 2000 else 28))) for i in range(4000)]  # 35 and 29 tokens of 64
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).repartitionByRange(8, "doc_id")
    rows = packing.pack(df, capacity=64, slack=1, partners=16).collect()
    n = check_packed(rows, docs, 64)
    assert n <= 1.05 * -(-sum(r.length for r in rows) // 64)
