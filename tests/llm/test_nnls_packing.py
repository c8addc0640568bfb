from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from campaign_metrics.llm import nnls_packing as op
from campaign_metrics.llm.queries import QUERIES
from campaign_metrics.llm.tokens import public_path

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def check_packed(rows, docs, capacity):
    """Every id of every row in exactly one piece, sequences gapless and without padding; returns sequences and pieces."""
    tokenizer = Tokenizer.from_file(public_path(op.TOKENIZER))
    want = Counter()
    by_doc = defaultdict(list)
    for d, t in docs:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want[d] += len(ids)
        by_doc[d].append(ids)
    got = Counter()
    for r in rows:
        assert r.length > 0
        got[r.doc_id] += r.length
        assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                   for ids in by_doc[r.doc_id])
    assert got == want
    for d, texts in by_doc.items():
        if len(texts) == 1:  # an id of one row: its pieces follow one another
            at = 0
            for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
                assert r.start == at
                at += r.length
            assert at == len(texts[0])
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    return len(sequences), len(rows)


@pytest.mark.parametrize("window, depth", [(1, 1), (7, 2), (12, 3), (12, 4), (16, 3)])
def test_mixes_are_all_multisets_that_fill_the_window(window, depth):
    lengths = np.array([n for n in range(1, window + 1) if n != 3])
    want = sorted(tuple(sorted(m, reverse=True)) for k in range(1, depth + 1)
                  for m in itertools.combinations_with_replacement(lengths.tolist(), k) if sum(m) == window)
    found = op.mixes_filling(window, lengths, depth)
    assert found.shape[1] == depth
    assert sorted(tuple(p for p in m if p) for m in found.tolist()) == want


@pytest.mark.parametrize("seed", range(5))
def test_least_squares_against_every_active_set(seed):
    rng = np.random.default_rng(seed)
    histogram = np.r_[0, rng.integers(0, 30, 8)]
    mixes = op.mixes_filling(8, np.flatnonzero(histogram), 3)
    a = np.zeros((9, len(mixes)))
    for s, mix in enumerate(mixes):
        for p in mix[mix > 0]:
            a[p, s] += 1
    best = np.sum(histogram[1:] ** 2)
    for k in range(1, min(len(mixes), 8) + 1):
        for active in itertools.combinations(range(len(mixes)), k):
            x = np.linalg.lstsq(a[1:, active], histogram[1:], rcond=None)[0]
            if (x >= -1e-9).all():
                best = min(best, np.sum((a[1:, active] @ x - histogram[1:]) ** 2))
    x = op.least_squares_repeats(mixes, histogram.astype(float), steps=2000)
    assert (x >= 0).all() and np.sum((a[1:] @ x - histogram[1:]) ** 2) == pytest.approx(best, rel=1e-3, abs=1e-3)


@pytest.mark.parametrize("seed", range(3))
def test_places_hold_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    histogram = np.r_[0, rng.integers(0, 40, 32)]
    places = op.plan(histogram, 3, 100)
    assert (places.used <= histogram).all() and places.used.sum() > histogram.sum() / 2
    sequences = defaultdict(list)
    for length in range(1, 33):
        for number in range(places.used[length]):
            at = np.searchsorted(places.key, (length << 40) + number, side="right") - 1
            sequences[int(places.sequence[at] + number - places.first[at])].append((int(places.offset[at]), length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 32


@pytest.mark.parametrize("lengths", [[], [5], [16], [3, 3, 3, 3, 3, 3, 3], [15] * 40, list(range(1, 16)) * 3, [1] * 37])
def test_windows_hold_every_token_once(lengths):
    windows = list(op.fill_windows(lengths, 16))
    seen = sorted((i, s + k) for w in windows for i, s, n in w for k in range(n))
    assert seen == [(i, k) for i, n in enumerate(lengths) for k in range(n)]
    sizes = [sum(n for _, _, n in w) for w in windows]
    assert all(s == 16 or s & (s - 1) == 0 for s in sizes) and sum(s < 16 for s in sizes) <= 4


def test_query_packs_every_document_without_padding(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = QUERIES["op13_nnls_packing"](spark, SMALL)
    assert out.columns[:7] == COLUMNS
    rows = out.collect()
    n, pieces = check_packed(rows, docs, 2048)
    tokens = sum(r.length for r in rows)
    assert n <= tokens / 2048 + 11
    cut_free = sum(-(-t // 2048) for t in {(r.doc_id, r.doc_tokens): r.doc_tokens for r in rows}.values())
    assert pieces <= cut_free + n


@pytest.mark.parametrize("group_tokens", [64, 1 << 22])
def test_odd_rows(spark, group_tokens):
    docs = [(1, None), (2, ""), (2, ""), (None, "a b c"), (None, None), (3, "word " * 500), (3, "word " * 500), (4, "a"), (5, "b " * 31)]
    docs += [(k, "same text " * 3) for k in range(10, 60)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, part int, ids string").repartition(5)
    rows = op.pack_by_histogram(df, capacity=32, group_tokens=group_tokens).collect()
    check_packed(rows, docs, 32)


def test_one_length_with_a_third_of_all_rows_and_lengths_no_mix_takes(spark):
    docs = [(k, "a " * (20 if k % 3 == 0 else 1 + k % 29)) for k in range(600)] + [(1000 + k, "a " * 30) for k in range(300)]
    rows = op.pack_by_histogram(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7), capacity=32).collect()
    n, _ = check_packed(rows, docs, 32)
    assert n <= sum(r.length for r in rows) / 32 + 5


def test_empty_table(spark):
    assert op.pack_by_histogram(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
