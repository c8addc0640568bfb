from __future__ import annotations

import random
import re
from itertools import permutations

import pandas as pd
import pytest

from campaign_metrics.llm import filter_audit as op
from campaign_metrics.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """Every order applied document by document."""
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)

    def failed(d, t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        upper = sum("A" <= c <= "Z" for c in t)
        return {c for c, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * upper > 3 * len(t), any(c in "#$%&*|" for c in t),
            d is not None and d > least[t])) if bad}

    good, toxic = ({d for d, q, x in labels if v((q, x)) == 1} - {None} for v in (lambda r: r[0], lambda r: r[1]))
    rows = {}
    for part in {p or "" for _, _, p in docs}:
        mine = [(d, failed(d, t)) for d, t, p in docs if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                out = [(d, f) for d, f in left if c in f]
                left = [(d, f) for d, f in left if c not in f]
                shapley[c] += len(out)
                rows[part, "".join(order), step] = [
                    len(left), len(out), sum(c in f for _, f in mine) - len(out), sum(f == {c} for _, f in mine),
                    sum(d in good for d, _ in out), sum(d in toxic for d, _ in out)]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return rows


def found(rows):
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in rows}


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    out = QUERIES["op12_filter_audit"](spark, SMALL)
    assert out.columns[:10] == COLUMNS
    rows = out.collect()
    assert found(rows) == brute(docs, labels) and len(rows) == 600 * len({d[2] for d in docs})


def test_odd_rows(spark):
    rng = random.Random(5)
    said = ["", "A", "a # b", "w " * 250, " ".join(f"w{k}" for k in range(300)), "É" * 40 + "A", "x\x85y z", "UP " * 199 + "\x1f", "a\x00|"]
    docs = [(None if rng.random() < 0.1 else rng.randrange(40), rng.choice([None, *said]), rng.choice([None, "", "en", "de"])) for _ in range(200)]
    docs += docs[:20] + [(100 + k, "one text of many copies", "en") for k in range(150)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(80)]
    df = spark.createDataFrame([(*d, 7, b"x", True) for d in docs],
                               "doc_id bigint, text string, lang string, mask int, digest binary, least boolean").repartition(6)
    lb = spark.createDataFrame([(*x, "en") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    assert found(op.audit_filters(df, lb).collect()) == brute(docs, labels)


def test_no_labels_and_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = [(1, "a", "x"), (2, "a", "x")]
    assert found(op.audit_filters(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), labels).collect()) == brute(docs, [])
    assert op.audit_filters(spark.createDataFrame([], "doc_id bigint, text string, lang string"), labels).collect() == []


def test_fields_hold_counts_beyond_32_bits_without_overflow():
    n = (1 << 63) - 1
    counts = pd.DataFrame({"mask": [31, 0], "docs": [n // 120, 0], "good": [n // 120, 0], "toxic": [0, 0]})
    out = op.audit_of("x", counts)
    assert (out["removed"] == [n // 120 if s == 1 else 0 for s in out["step"]]).all() and (out["good_lost"] == out["removed"]).all()
    assert (out["redundant"] == [0 if s == 1 else n // 120 for s in out["step"]]).all()


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_words_of_a_text_in_chunks(chunk):
    text = b"one  two\tthree \n\x0bfour\xc3\xa9 " + b"x" * 50 + b" end"
    assert sum(op._word_lists(text, chunk), []) == text.split()
