from __future__ import annotations

import random
import re

import numpy as np
import pytest

from campaign_metrics.llm import quality as Q
from campaign_metrics.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plain(text):
    """Base counts straight from the contract."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    repeat = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    base = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(repeat))
    return base, len(words) < 10 or 100 * len(repeat) > 20 * len(words)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "é ü ß x", "a b c d e a b c d e", "a a a a a a a", "x\n x\nx\n\n \nx \nx",
                                  "#*$%&|<> [] #", "a\r\nb\r\na\r\nb", "one two three four five six seven eight nine ten",
                                  " ".join("abcdefghij" * 3), "日本語 テキスト 全角"])
def test_base_counts(text):
    base, _ = Q.text_statistics((text or "").encode())
    assert tuple(base) == plain(text)[0]
    assert bool(Q.base_failed(np.array([base]))[0]) == plain(text)[1]


def scored(model, x):
    """One row, node by node."""
    total = model.bias
    for root in model.roots:
        node = root
        while model.feature[node] >= 0:
            node = (model.left if x[model.feature[node]] <= model.threshold[node] else model.right)[node]
        total += model.value[node]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_follow_the_nodes_and_the_constraints():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((np.sin(3 * x[:, 0]) - x[:, 1] + 0.3 * rng.normal(size=2000)) > 0).astype(float)
    model = Q.fit_trees(x, y, [-1, -1, 1], trees=40)
    p = model.score(x)
    assert np.allclose(p[:50], [scored(model, r) for r in x[:50]])
    assert ((p > 0.5) == y).mean() > 0.75
    grid = np.linspace(-3, 3, 60)
    for row in x[:40]:
        for f, sign in enumerate([-1, -1, 1]):
            line = np.tile(row, (60, 1))
            line[:, f] = grid
            assert (np.diff(model.score(line)) * sign >= -1e-12).all()


def test_query_has_the_base_counts_and_judges_held_out_labels(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op1_quality_rules"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        base, failed = plain(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == failed and not (failed and r.kept)
    big = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = Q.fit_quality(d, labels.filter("doc_id % 2 = 0"))
    judged = Q.judge_quality(d, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    right = sum(r.kept == (r.quality == 1) for r in judged)
    assert len(judged) > 100 and right / len(judged) > 0.97


def test_odd_rows(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None, 1), (None, good, 2), (2, good, 3), (2, good, 3), (3, "x " * 60000, 4), (4, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(2)
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (3, None), (9, 0)], "doc_id long, quality int")
    model = Q.fit_quality(docs, labels)
    assert sorted((r.doc_id or 0, r.kept) for r in Q.judge_quality(docs, model).collect()) == [
        (0, True), (1, False), (2, True), (2, True), (3, False), (4, False)]
    kept = Q.keep_quality(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 2]
    empty = docs.limit(0)
    assert Q.judge_quality(empty, Q.fit_quality(empty, labels.limit(0))).count() == 0
    assert Q.keep_quality(empty, Q.fit_quality(docs, labels.limit(0))).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_long_texts_have_the_same_statistics(seed, monkeypatch):
    rng = random.Random(seed)
    spaces = [" ", "\n", "  ", "\t\r\n", "\x0b", "\x0c"]
    text = "".join(rng.choice(["a", "B", "é", "word!", "7", "#x"]) * rng.randint(0, 3) + rng.choice(spaces) for _ in range(rng.choice([0, 3, 400]))).encode()
    want = Q.text_statistics(text)
    monkeypatch.setattr(Q, "CHUNK", 16)
    monkeypatch.setattr(Q._long_text_words, "__defaults__", (16,))
    assert Q.text_statistics(text) == want


def test_a_long_text_takes_a_few_times_its_size():
    import tracemalloc
    text = b"some words that come again and again and others 12345 too. " * 100_000
    tracemalloc.start()
    Q.text_statistics(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(text)
