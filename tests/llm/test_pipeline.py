"""The pipeline stage by stage against plain Python over the small tables."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline as P
from campaign_metrics.llm import simhash as S
from campaign_metrics.llm.decontaminate import words_of
from campaign_metrics.llm.quality import THRESHOLD, base_failed, fit_quality, text_statistics
from campaign_metrics.llm.tables import table
from campaign_metrics.llm.tokens import encoder, public_path

SMALL = "/root/testdata/sf0.001"


def one_per_class(docs):
    """Ids that stay: the least of every class, linked by all pairs."""
    fp = {i: S.fingerprint((t or "").encode()) & (1 << 64) - 1 for i, t in docs.items()}
    ids, root = sorted(fp), {i: i for i in fp}
    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i for i in ids if root[i] == i}


def windows(text):
    w = words_of((text or "").encode())
    n = min(10, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_each_stage_takes_effect(spark):
    docs, benchmark = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = fit_quality(docs, table(spark, SMALL, "labels"))
    good = {}
    for i, t in texts.items():
        base, x = text_statistics((t or "").encode())
        if not base_failed(S.np.array([base]))[0] and model.score(S.np.array([x], dtype=float))[0] >= THRESHOLD:
            good[i] = t
    single = one_per_class(good)
    tests = set().union(*(windows(r.text) for r in benchmark.collect()))
    sizes = {len(w) for w in tests}
    def leaks(t):
        w = words_of((t or "").encode())
        return any(tuple(w[i:i + n]) in tests for n in sizes for i in range(len(w) - n + 1))
    clean = {i for i in single if not leaks(good[i])}
    want = [set(good), single, clean, clean]
    kept = docs
    for (name, stage), ids in zip(P.STAGES[:4], want):
        kept = P.written(stage(spark, kept, SMALL), name)
        rows = kept.collect()
        assert kept.columns == docs.columns, name
        assert Counter(r.doc_id for r in rows) == Counter(ids), name
    assert len(texts) > len(good) > len(single) > len(clean) > 0
    assert all(r.n_chars == len(r.text) for r in rows)
    assert not any(re.search("AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r.text) for r in rows)
    pieces = P.STAGES[4][1](spark, kept, SMALL).collect()
    encode = encoder(public_path("word_bpe_49k.json"))
    tokens = {r.doc_id: len(encode(r.text.encode())) // 4 + 1 for r in rows}
    packed = Counter()
    for p in pieces:
        packed[p.doc_id] += p.length
    assert packed == tokens


def test_empty_and_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0)],
                                 table(spark, SMALL, "documents").schema)
    for rows in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            rows = P.written(stage(spark, rows, SMALL), "odd")
        assert rows.count() == 0
