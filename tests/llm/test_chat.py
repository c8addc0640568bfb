from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from campaign_metrics.llm import chat as C
from campaign_metrics.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
CONTROLS = ["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[TURN]", "\\", "<", "[", "]", ">", "/", "s>", "INST]", "<\\s>", "[\\\\/INST]", "$1", "\n", "é", "😀", "a"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def order(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def plain(rows):
    """conv -> (n_turns, turns digest, loss characters, loss digest)."""
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=order)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def check(spark, rows, **params):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    windows = C.chat_windows(df, **params)
    got = {r.conv_id: tuple(r)[1:5] for r in C.chat_digest(windows).collect()}
    assert got == plain(rows)
    return windows.collect()


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(5)
    texts = CONTROLS + ["".join(rng.choices(CONTROLS, k=rng.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escape(F.col("t")).alias("e"))
    for r in df.withColumn("back", C.unescape(F.col("e"))).collect():
        assert r.back == r.t
        assert not any(m in r.e for m in ["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN]", "[/TURN]"])


@pytest.mark.parametrize("budget,history,chunk", [(1024, 256, 256), (64, 16, 2), (40, 0, 1), (200, 150, 3)])
def test_windows_read_back_and_keep_the_budget(spark, budget, history, chunk):
    rng, rows = random.Random(budget), []
    for c in range(25):
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "assistant", "tool\\n\nx", "[INST]"])
            rows.append((c, t, role, "".join(rng.choices(CONTROLS, k=rng.randint(0, 60)))))
    windows = check(spark, rows, budget=budget, history=history, chunk=chunk)
    text = {(c, t): x for c, t, _, x in rows}
    systems = {c: text[c, 0] for c, t, r, _ in rows if t == 0 and r == "system"}
    first = {c: min(w.window for w in windows if w.conv_id == c) for c in {w.conv_id for w in windows}}
    turns = spark.createDataFrame([(w.conv_id, w.window, w.formatted, w.n_repeated) for w in windows], "c long, w long, f string, n int").select(
        "c", "w", "n", C.read_turns(F.col("f")).alias("t")).collect()
    for r in turns:
        own, repeated = r.t[r.n:], r.t[:r.n]
        cost = lambda ts: sum(-(-len(t.text) // 4) + 4 for t in ts)
        if r.c in systems and r.w != first[r.c]:
            assert (repeated[0].role, repeated[0].text) == ("system", systems[r.c])
            repeated = repeated[1:]
        assert cost(repeated) <= history + max([cost([t]) for t in repeated], default=0)
        left = budget - history - (cost([t for t in r.t[:1] if t.role == "system"]) if r.c in systems else 0)
        assert len(own) == 1 or cost(own) <= 2 * max(left // 2 + 50, budget // 8)


def test_hot_conversation_and_odd_rows(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", f"turn {t} </s> " * (t % 9)) for t in range(3000)]
    rows += [(1, 0, None, None), (1, 0, None, None), (None, 1, "user", "x"), (None, None, "assistant", "y"), (2, None, "system", "s"),
             (2, 1, "assistant", "[INST]" * 4000), (3, 5, "assistant", ""), (4, 0, "system", "only"), (5, -3, "user", "neg"), (5, 3, "assistant", "pos")]
    check(spark, rows)
    extra = spark.createDataFrame([(1, 0, "user", "hi", 5, "w")], SCHEMA + ", window int, conv string")
    assert C.chat_windows(extra).count() == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert C.chat_windows(empty).count() == 0 and C.chat_digest(C.chat_windows(empty)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    got = QUERIES["op8_chat_formatting"](spark, SMALL)
    assert {r.conv_id: tuple(r)[1:5] for r in got.collect()} == plain(rows + [(-1, 0, "user", odd), (-1, 1, "assistant", odd)])
    names = str(got._jdf.queryExecution().executedPlan())
    assert "Python" not in names and "Arrow" not in names
