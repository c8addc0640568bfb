from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from campaign_metrics.llm import sketch_search as op
from campaign_metrics.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top=50):
    """Sorted (item_id, [(rank, doc_id, score)]) of all distinct items."""
    said = [(d, c) for d, t in docs if (c := Counter(terms(t)))]
    n, total = len(said), sum(sum(c.values()) for _, c in said)
    df = Counter(t for _, c in said for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in said:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        best = [(k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
        if best:
            out.append((item, best))
    return sorted(out, key=repr)


def found(rows, items):
    """The rows in the shape of ``brute``; rows of one item_id are told apart by their ranks."""
    lists = defaultdict(list)
    for r in rows:
        lists[r.item_id].append((r.rank, r.doc_id, r.score))
    assert all(len({k for k, _, _ in v}) == len(v) for v in lists.values())
    return sorted(((i, sorted(v)) for i, v in lists.items()), key=repr)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    out = QUERIES["op11_sketch_search"](spark, SMALL)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and dict(out.dtypes)["rank"] == "int"
    assert found(out.collect(), items) == brute(docs, items)


@pytest.mark.parametrize("width, block_docs, batch_chars", [(1, 5, 10 ** 9), (7, 3, 10 ** 9), (64, 1000, 40)])
def test_odd_rows_narrow_sketches_and_batches(spark, width, block_docs, batch_chars):
    rng = random.Random(width)
    words = ["a", "b", "C", "déjà", "É", "x1", "zz", "the", "_", "--", "İ"]
    docs = [(rng.choice([None, *range(30)]), rng.choice([None, "", "?!", " ".join(rng.choices(words, k=rng.randint(1, 30)))])) for _ in range(80)]
    docs += [(50, "tie one"), (49, "tie one"), (None, "tie one"), (50, "tie one"), (60, "long " * 5000 + "tie")]
    items = [(1, "a b c"), (2, None), (3, "?!"), (4, "unknown words"), (None, "tie the é"), (5, "tie ONE tie"), (5, "tie ONE tie"), (6, "zz " * 50 + "x1"), (7, "C É İ")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, query string, score int").repartition(4)
    it = spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, rank int")
    rows = op.search(df, it, top=6, width=width, block_docs=block_docs, batch_chars=batch_chars).collect()
    assert found(rows, items) == brute(docs, items, 6)


def test_items_of_one_id_with_different_texts_are_ranked_each(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id bigint, text string")
    rows = op.search(docs, spark.createDataFrame([(1, "a"), (1, "b")], "item_id bigint, text string")).collect()
    assert sorted((r.item_id, r.rank, r.doc_id) for r in rows) == [(1, 1, 1), (1, 1, 2)]


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{c} bigint, text string") for c in ("doc_id", "item_id"))
    one = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert op.search(docs, items).collect() == op.search(one, items).collect() == []
    assert op.search(docs, one.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_bounds_hold_and_spare_documents():
    rng = np.random.default_rng(1)
    words = [f"w{k}".encode() for k in range(3000)]
    texts = [[words[k] for k in rng.zipf(1.3, rng.integers(20, 200)) % 3000] for _ in range(600)]
    total = sum(map(len, texts))
    df = Counter(t for x in texts for t in set(x))
    queries = [op.Query(k, q := list(dict.fromkeys(texts[k][:30])), [op.weight(df[t], 600) for t in q]) for k in range(20)]
    best = op.Best(queries, 10, 512)
    for i in range(0, 600, 200):
        block = op.make_block(list(range(i, i + 200)), texts[i:i + 200], 600, total, 512)
        for k, q in enumerate(queries):
            bounds = best.weights[k] @ block.sketches[best.places[k]]
            assert all(b >= op.exact_score(q, c, m) for b, c, m in zip(bounds, block.counts, block.norms))
        best.add(block)
    assert best.rescored < 20 * 600 / 2
