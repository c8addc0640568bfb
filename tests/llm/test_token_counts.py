from __future__ import annotations

import random
import re

import pytest

from campaign_metrics.llm import token_counts as T
from campaign_metrics.llm.queries import QUERIES
from campaign_metrics.llm.tables import table
from campaign_metrics.llm.tokens import public_path
from campaign_metrics.session import scratch_path

SMALL = "/root/testdata/sf0.001"
CHANGES = ("doc_id bigint, tokenizer_version string, source string, lang string, tokens bigint, chars bigint, "
           "deleted boolean, seq bigint, batch string, sign string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def totals(state):
    out = {}
    for (_, version), (source, lang, tokens, chars) in state.items():
        t = out.setdefault((source, lang, version), [0, 0, 0])
        t[0] += 1
        t[1] += tokens
        t[2] += chars
    return sorted(((*k, *v) for k, v in out.items()), key=str)


@pytest.fixture
def rollup(spark):
    return T.TokenRollup(spark, scratch_path(spark, "token-test"))


def change(doc, tokens=1, source="s", lang="en", version="v1", chars=1, deleted=False, seq=0):
    return doc, version, source, lang, tokens, chars, deleted, seq, "x", "y"


def test_random_batches_match_a_dictionary(spark, rollup):
    rnd, state = random.Random(5), {}
    for batch in range(1, 5):
        made = [change(rnd.choice([None, *range(12)]), rnd.randrange(5), rnd.choice(["hot", "hot", "b", None]), rnd.choice(["en", None]),
                       rnd.choice(["v1", "v2", None]), rnd.randrange(9), rnd.random() < 0.3, seq) for seq in range(20)]
        for c in made:
            if c[6]:
                state.pop((c[0], c[1]), None)
            else:
                state[c[0], c[1]] = c[2:6]
        df = spark.createDataFrame(rnd.sample(made, len(made)), CHANGES)
        assert rollup.apply(batch, df)
        assert rows(rollup.totals()) == totals(state)
        assert not rollup.apply(batch, df)
        assert rows(rollup.totals()) == totals(state)
    assert rollup.compact(9) and not rollup.compact(9)
    assert rows(rollup.totals()) == totals(state)
    assert rollup.commits().count() == 1
    rollup.apply(10, spark.createDataFrame([change(99, 7)], CHANGES))
    assert rows(rollup.totals()) == totals({**state, (99, "v1"): ("s", "en", 7, 1)})
    with pytest.raises(ValueError):
        rollup.apply(8, spark.createDataFrame([], CHANGES))


@pytest.mark.parametrize("dies_at", ["deltas", "commits"])
def test_a_batch_that_died_is_not_read_and_can_run_again(spark, rollup, monkeypatch, dies_at):
    rollup.apply(1, spark.createDataFrame([change(1, 5), change(2, 6)], CHANGES))
    before = rows(rollup.totals())
    replace = T.TokenRollup._replace

    def failing(self, df, name):
        if name == dies_at:
            raise RuntimeError("lost")
        replace(self, df, name)

    batch = spark.createDataFrame([change(1, 9), change(2, deleted=True)], CHANGES)
    with monkeypatch.context() as m:
        m.setattr(T.TokenRollup, "_replace", failing)
        with pytest.raises(RuntimeError):
            rollup.apply(2, batch)
    assert rows(rollup.totals()) == before
    again = T.TokenRollup(spark, rollup.path)  # a new driver on the same folders
    assert again.apply(2, batch)
    assert rows(again.totals()) == [("s", "en", "v1", 1, 9, 1)]


def test_ties_empty_batches_and_null_counts(spark, rollup):
    assert rollup.apply(1, spark.createDataFrame([], CHANGES))
    assert rows(rollup.totals()) == []
    rollup.apply(2, spark.createDataFrame([change(1, 3), change(1, 3), change(1, deleted=True), change(2, None, chars=None),
                                           change(3, 4, deleted=None, seq=None), change(4, deleted=True)], CHANGES))
    assert rows(rollup.totals()) == [("s", "en", "v1", 2, 4, 1)]


def test_distinct_query_matches_plain_counts(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    docs = table(spark, SMALL, "documents").collect()
    least, state = {}, {}
    for d in docs:
        least[d.text or ""] = min(d.doc_id, least.get(d.text or "", d.doc_id))
    for d in docs:
        text = d.text or ""
        if least[text] == d.doc_id:
            state[d.doc_id, "words"] = d.source, d.lang, len(re.findall("[^\x20\x09-\x0D]+", text)), len(text)
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            state[d.doc_id, "word_bpe_49k"] = d.source, d.lang, len(ids), len(text)
    assert len(state) < 2 * len(docs)
    assert rows(QUERIES["op10_token_counts_distinct"](spark, SMALL)) == totals(state)


def test_odd_documents(spark, rollup):
    docs = spark.createDataFrame([(None, None, None, None, 1), (None, "a b", "s", "en", 1), (1, "", "s", "en", 1), (2, " \n", "s", "en", 1),
                                  (2, " \n", "s", "en", 1), (3, "", "s", "en", 1), (4, "x " * 200_000, "s", "en", 1)],
                                 "doc_id bigint, text string, source string, lang string, digest int")
    T.roll_up_documents(rollup, docs)
    got = {(r.source, r.tokenizer_version): (r.docs, r.tokens) for r in rollup.totals().collect()}
    assert got[("s", "words")] == (4, 200_002)  # ids null (its larger row), 1, 2 and 4; id 3 copies id 1
    assert got[("s", "word_bpe_49k")][0] == 4


def test_all_rows_are_counted(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    state = {}
    for k, d in enumerate(table(spark, SMALL, "documents").collect()):
        text = d.text or ""
        state[k, "words"] = d.source, d.lang, len(re.findall("[^\x20\x09-\x0D]+", text)), len(text)
        state[k, "word_bpe_49k"] = d.source, d.lang, len(tokenizer.encode(text, add_special_tokens=False).ids), len(text)
    assert rows(QUERIES["op10_token_counts_all"](spark, SMALL)) == totals(state)
    assert rows(QUERIES["op10_token_counts"](spark, SMALL)) == totals(state)


def test_a_batch_reads_the_buckets_of_the_documents_that_it_names(spark, rollup):
    rollup.apply(1, spark.createDataFrame([change(k, k) for k in range(200)] + [change(None, 3)], CHANGES))
    named = spark.createDataFrame([(7, "v1"), (None, "v1"), (500, "v1")], "doc_id bigint, tokenizer_version string")
    old = rollup._current_of(named)
    assert sorted((r.doc_id or -1, r.tokens) for r in old.collect()) == [(-1, 3), (7, 7)]
    plan = old._jdf.queryExecution().optimizedPlan().toString()
    read = re.search(r"bucket#\d+ IN \(([^)]*)\)", plan)
    assert read and 1 <= len(read[1].split(",")) <= 3, plan


def test_rows_without_an_id_of_their_own_are_counted(spark, rollup):
    docs = spark.createDataFrame([(None, "a b", "s", "en"), (None, "c", "s", "en"), (1, "d", "s", "en"), (1, "d", "s", "en"), (1, "e", "s", "en"),
                                  (2, "d", "s", "en"), (-1, None, "s", "en")], "doc_id bigint, text string, source string, lang string")
    T.roll_up_rows(rollup, docs)
    got = {r.tokenizer_version: (r.docs, r.tokens, r.chars) for r in rollup.totals().collect()}
    assert got["words"] == (7, 7, 8) and got["word_bpe_49k"][0] == 7
