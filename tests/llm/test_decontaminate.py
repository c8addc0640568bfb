from __future__ import annotations

import hashlib
import random
import re

import pytest

from campaign_metrics.llm import decontaminate as D
from campaign_metrics.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for win, ids in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_search_equals_brute_force(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 7, 9])))) for i in range(5)]
    tables = D.build_tables([(str(i), t.encode()) for i, t in items], 4)
    docs = [(k, " ".join(word() for _ in range(rng.choice([0, 3, 40])))) for k in range(30)]
    for want, (_, text) in zip(plain(docs, items, 4), docs):
        spans, found = D.find_hits(D.words_of(text.encode()), tables)
        assert (sum(b - a for a, b in zip(spans[::2], spans[1::2])), len(found)) == want[2:4]


@pytest.mark.parametrize("shard_chars", [D.SHARD_CHARS, 60])
def test_odd_rows_and_shards(spark, shard_chars):
    long = "lorem ipsum " * 20000
    items = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (2, "short item"), (3, None),
             (4, "... !!"), (None, "nameless words here"), (12, "five six seven eight nine ten eleven twelve thirteen fourteen")]
    docs = [(1, "x ONE two-three four five six seven eight nine ten. eleven twelve thirteen fourteen"), (2, None), (3, ""),
            (4, long + " Short ITEM " + long), (4, "nameless words here"), (None, "short. item"), (5, "clean words only")]
    d = spark.createDataFrame([(*r, 0, "h") for r in docs], "doc_id long, text string, n_words int, hits string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert order(D.contamination(d, b, shard_chars=shard_chars).collect()) == order(plain(docs, items))
    kept = D.drop_contaminated(d, b, shard_chars=shard_chars)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    assert D.contamination(d.limit(0), b).count() == 0
    assert D.contamination(d, b.limit(0)).filter("contaminated or n_items > 0").count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()[:60]
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op5_benchmark_decontamination"](spark, SMALL).collect()}
    for want in plain(docs, items):
        assert got[want[0]] == want


def test_shards_bounded_by_measured_bytes_find_the_same(spark):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 4, 30])))) for k in range(60)]
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(300))) for k in range(20)]
    pairs = [(str(i), t.encode()) for i, t in items]
    whole = D.build_tables(pairs)
    shards = list(D.bounded_tables(pairs, D.WINDOW, whole.nbytes() // 4))
    assert len(shards) > 3 and all(s.nbytes() <= whole.nbytes() // 4 for s in shards)
    for _, text in docs:
        words = D.words_of(text.encode())
        spans, found = D.find_hits(words, whole)
        parts = [D.find_hits(words, s) for s in shards]
        assert sorted(i for _, f in parts for i in f) == found
        covered = lambda flat: {p for a, b in zip(flat[::2], flat[1::2]) for p in range(a, b)}
        assert covered(spans) == set().union(*(covered(s) for s, _ in parts))
    d = spark.createDataFrame([(*r, 1, 2, "m") for r in docs], "doc_id long, text string, _more int, _HITS int, _more_ string")
    b = spark.createDataFrame(items, "item_id long, text string")
    few = D.with_hits(d, b, shard_chars=300, shard_bytes=10_000)
    assert few.columns == [*d.columns, "hits"] and [r._more_ for r in few.collect()] == ["m"] * 20
    kept = D.drop_contaminated(d, b, shard_chars=300)
    assert kept.columns == d.columns and {tuple(r) for r in kept.collect()} == {
        (*r, 1, 2, "m") for r in docs if not D.find_hits(D.words_of(r[1].encode()), whole)[0]}


def test_tables_take_little_memory_for_a_benchmark_of_millions_of_characters():
    rng = random.Random(1)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(60_000)]
    items = [(str(k), " ".join(rng.choices(words, k=400)).encode()) for k in range(1000)]
    chars = sum(len(t) for _, t in items)
    tables = D.build_tables(items)
    assert chars > 2_500_000 and tables.nbytes() < 32 * chars
    words = D.words_of(items[5][1])
    spans, found = D.find_hits(words, tables)
    assert spans == [0, 400] and found == ["5"]
