from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from campaign_metrics.llm import language as L
from campaign_metrics.llm.queries import QUERIES
from campaign_metrics.llm.tables import table

CHECKED = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, held_out int, score string"


def plain_grams(text):
    codes = [32, *(ord(c) if c.isalpha() else 32 for c in text.lower()), 32]
    return Counter((n, tuple(codes[i:i + n])) for n in (1, 2, 3) for i in range(len(codes) - n + 1))


@pytest.mark.parametrize("text", ["a", "Ab, cd! 1", "é日本 語", "x " * 50])
def test_counts_are_those_of_all_grams(text, monkeypatch):
    whole = L.gram_counts(text)
    assert whole[1].sum() == sum(plain_grams(text).values())
    assert len(whole[0]) == len(plain_grams(text))  # no two of these few grams share a bucket
    for size in (2, 3, 7):
        monkeypatch.setattr(L, "BLOCK", size)
        cut = L.gram_counts(text)
        assert [a.tolist() for a in cut] == [a.tolist() for a in whole]


def test_no_letter_is_unknown():
    for text in (None, "", " \n", "123 !? ₀"):
        assert not len(L.gram_counts(text)[0])


def test_ftrl_step_is_the_closed_form():
    x = np.array([0.6, 0.8])
    w, b = L.ftrl([(np.array([0, 2]), x)], np.array([1]), 2, buckets=3, epochs=1, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    g = np.outer(x, [0.5, -0.5])
    want = -np.sign(g) * (np.abs(g) - 0.1) / ((1 + np.abs(g)) / 0.5 + 0.2)
    assert np.allclose(w[[0, 2]], want) and not w[1].any()
    assert np.allclose(b, [-0.5 / (1.5 / 0.5 + 0.2), 0.5 / (1.5 / 0.5 + 0.2)])
    strong = L.ftrl([(np.array([0, 2]), x)], np.array([1]), 2, buckets=3, epochs=1, l1=0.45)[0]
    assert not strong.any()  # L1 keeps weak features at zero


def test_temperature_recovers_scale():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in L.softmax(z)])
    assert abs(L.best_temperature(z * 5, labels) - 5) < 0.5


def test_held_out_accuracy_and_calibration(spark):
    rows = {r.doc_id: r for r in QUERIES["op9_language_id"](spark, CHECKED).collect()}
    docs = table(spark, CHECKED, "documents").collect()
    assert len(rows) == len(docs)
    right, scores = [], []
    for d in docs:
        r = rows[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d.text or ""))
        if r.held_out and r.lang_pred != "und":
            right.append(r.lang_pred == d.lang)
            scores.append(r.score)
    assert np.mean(right) >= 0.97
    assert abs(np.mean(right) - np.mean(scores)) < 0.05


def test_prediction_sees_the_text_alone_and_learns_outside_the_fold(spark):
    docs = table(spark, CHECKED, "documents").select("doc_id", "text", "lang")
    model = L.fit_language(docs)
    spoiled = docs.selectExpr("doc_id", "text", f"if(crc32(cast(cast(doc_id as string) as binary)) % 4 = {L.HELD_OUT}, 'zz', lang) as lang")
    again = L.fit_language(spoiled)
    assert again.languages == model.languages == ["de", "en", "es", "fr"]
    assert np.array_equal(again.weights, model.weights) and again.temperature == model.temperature
    assert 0 < np.count_nonzero(model.weights) < model.weights.size / 2


def test_odd_tables(spark):
    one = spark.createDataFrame([(1, "abc", "en", 1, "x"), (1, "abc", "en", 1, "x"), (None, None, "en", 1, "x"), (3, "7", None, 1, "x"),
                                 (None, "zz", "fr", 1, "x"), (4, "lang " * 300_000, None, 1, None)], SCHEMA)
    got = L.predict_language(one, L.fit_language(one)).collect()
    assert sorted((r.doc_id or 0, r.lang_pred, r.score) for r in got) == [
        (0, "en", 1.0), (0, "und", 0.0), (1, "en", 1.0), (1, "en", 1.0), (3, "und", 0.0), (4, "en", 1.0)]
    bare = one.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in L.predict_language(bare, L.fit_language(bare)).collect()} == {"und"}
    assert L.predict_language(one.limit(0), L.fit_language(one.limit(0))).collect() == []


def test_letterless_and_repeated_rows_leave_room_for_every_language(spark):
    rows = [(k, "12 34", "de") for k in range(3000)] + [(1, "all the same", "en")] * 3000
    rows += [(10_000 + k, f"wort {k}", "de") for k in range(9)] + [(20_000 + k, f"mot {k}", "fr") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    train = docs.filter(L.remainder() != L.HELD_OUT).filter(docs.text.rlike(r"\p{L}"))
    got = L._sample(train, 30)
    assert Counter(got["lang"]) == {"de": train.filter("lang = 'de'").count(), "en": 1, "fr": 10}
    assert L._sample(train.repartition(3), 30).equals(got)
    assert L.fit_language(docs, sample=30).languages == ["de", "en", "fr"]


def plain_bucket(gram):
    """The bucket of a tuple of code points, one multiplication at a time."""
    h = gram[0]
    for c in gram[1:]:
        h = (h * 0x01000193 + c) % 2 ** 32
    odd = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[len(gram) - 1]
    return (h * odd % 2 ** 32) >> (33 - L.BUCKETS.bit_length())


def test_predictions_equal_a_plain_predictor_over_the_fitted_weights(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = L.fit_language(docs)
    got = {r.doc_id: r for r in L.predict_language(docs, model).collect()}
    for d in docs.collect()[:60]:
        if not any(c.isalpha() for c in d.text or ""):
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0.0)
            continue
        counts = Counter()
        for (_, gram), n in plain_grams(d.text).items():
            counts[plain_bucket(gram)] += n
        x = {b: (1 + math.log(n)) * float(model.idf[b]) for b, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * float(model.weights[b, k]) for b, v in x.items()) + float(model.bias[k])) / model.temperature
             for k in range(len(model.languages))]
        e = [math.exp(v - max(z)) for v in z]
        best = max(range(len(z)), key=z.__getitem__)
        assert got[d.doc_id].lang_pred == model.languages[best]
        assert got[d.doc_id].score == pytest.approx(e[best] / sum(e), abs=1e-6)
