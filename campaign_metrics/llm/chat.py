"""Chat formatting into budgeted windows, in DataFrame functions only.

The running sum of a conversation's turn tokens is cut into blocks of ``stride`` tokens, half of what the budget leaves after
history and system turn. A window holds the turns that start in one block, so it spans at most two strides; a turn of more
than a stride is a window of its own (after the others of its block, where it is last). Windows thus follow from prefix
sums alone. A window repeats the conversation's opening system turn and those earlier turns that start within
``HISTORY`` tokens before it. Loss covers the assistant texts of a window's own turns; everything repeated is masked.

Prefix sums are taken in two levels, over chunks of ``CHUNK`` turn numbers and inside a chunk, and windows are grouped by
(conversation, window), so a conversation that holds a third of all rows is spread over tasks.

Template: ``[SYS]..[/SYS]``, ``[INST]..[/INST]`` for user, ``<s>..</s>`` for assistant, ``[TURN]role\\n..[/TURN]`` for any
other role. In texts, a backslash after the first character breaks every control string, one more if some are there already;
taking one away restores the text.

Defined cases: a null text or role is empty; rows of one conversation are ordered by turn, then role, then text, nulls first,
repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives an empty result; a turn over the
budget is kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
CHUNK = 256

_CONTROL = r"(/?s>|/?INST\]|/?SYS\]|/?TURN\])"
_ESCAPE = r"([<\[])(\\*)" + _CONTROL
_UNESCAPE = r"([<\[])\\(\\*)" + _CONTROL
_TURN = r"(?s)\[SYS\].*?\[/SYS\]|\[INST\].*?\[/INST\]|<s>.*?</s>|\[TURN\].*?\[/TURN\]"
_MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_OTHER = ("[TURN]", "[/TURN]")
_NONE = -(1 << 63)  # stands for null in grouping keys


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def turn_tokens(text: Column) -> Column:
    """Estimate: a token for four characters, four for the marks."""
    return (F.ceil(F.length(text) / 4) + 4).cast("bigint")


def _by_role(role: Column, place: int) -> Column:
    out = F.lit(_OTHER[place])
    if place == 0:  # another role's name stands in the text's first line
        out = F.concat(out, escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))), F.lit("\n"))
    for name, marks in _MARKS.items():
        out = F.when(role == name, F.lit(marks[place])).otherwise(out)
    return out


def _placed(turns: DataFrame, budget: int, history: int, chunk: int, tokens) -> DataFrame:
    """Every turn with its start in the running sum, its window and its conversation's opening system turn."""
    key = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(_NONE))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"tokens": tokens(F.col("text")), "conv": key("conv_id"), "chunk": F.floor(key("turn") / chunk)})
    heads = rows.groupBy("conv", "chunk").agg(F.sum("tokens").alias("total"), F.min(F.struct("turn", "role", "text")).alias("head"))
    along = Window.partitionBy("conv").orderBy("chunk")
    heads = heads.select(
        "conv", "chunk",
        F.coalesce(F.sum("total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.first("head").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("head"))
    heads = heads.select("conv", "chunk", "before", F.when(F.col("head.role") == "system", F.col("head.text")).alias("system"))
    inside = Window.partitionBy("conv", "chunk").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(heads, ["conv", "chunk"]).withColumn(
        "start", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    left = budget - history - F.coalesce(tokens(F.col("system")), F.lit(0))
    placed = placed.withColumn("stride", F.greatest(F.floor(left / 2), F.lit(max(1, budget // 8))))
    block = F.floor(F.col("start") / F.col("stride"))
    return placed.withColumn("window", 2 * block + (F.col("tokens") > F.col("stride")).cast("bigint"))


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, chunk: int = CHUNK, tokens=turn_tokens) -> DataFrame:
    """Windows of ``turns`` (conv_id, turn, role, text).

    conv_id, window (their order), formatted, loss_spans (start, end of assistant texts in code points of ``formatted``),
    n_repeated (turns at its front that repeat earlier ones), n_tokens.
    """
    placed = _placed(turns, budget, history, chunk, tokens)
    last = 2 * F.floor((F.col("start") + history) / F.col("stride")) + 1
    opening = (F.col("start") == 0) & F.col("system").isNotNull()  # repeated as system turn, not as history
    later = F.when(~opening & (last > F.col("window")), F.sequence(F.col("window") + 1, last)).otherwise(F.array().cast("array<bigint>"))
    sent = placed.select("conv", "conv_id", F.explode(F.concat(F.array("window"), later)).alias("into"), "window", "start",
                         "role", "text", "system", "tokens")
    own = F.col("into") == F.col("window")
    grouped = sent.groupBy("conv", "conv_id", F.col("into").alias("window")).agg(
        F.array_sort(F.collect_list(F.struct("start", "role", "text", "tokens", own.alias("own")))).alias("turns"),
        F.min(F.when(own, F.col("start"))).alias("first"), F.max("system").alias("system"))
    grouped = grouped.filter("first is not null")
    kept = F.filter("turns", lambda t: t["own"] | ((t["start"] < F.col("first")) & (t["start"] >= F.col("first") - history)))
    opener = F.when((F.col("first") > 0) & F.col("system").isNotNull(), F.array(F.struct(
        F.lit(-1).cast("bigint").alias("start"), F.lit("system").alias("role"), F.col("system").alias("text"),
        tokens(F.col("system")).alias("tokens"), F.lit(False).alias("own"))))
    shown = grouped.select("conv_id", "window", F.concat(F.coalesce(opener, F.filter("turns", lambda t: F.lit(False))), kept).alias("turns"))
    marked = shown.withColumn("parts", F.transform("turns", lambda t: F.struct(
        _by_role(t["role"], 0).alias("open"), escape(t["text"]).alias("body"), _by_role(t["role"], 1).alias("close"),
        (t["own"] & (t["role"] == "assistant")).alias("loss"))))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["open"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + F.length(p["close"])).alias("at"),
                        F.when(p["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return marked.select(
        "conv_id", "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["open"], p["body"], p["close"])), "").alias("formatted"),
        F.aggregate("parts", F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"]).alias("loss_spans"),
        F.size(F.filter("turns", lambda t: ~t["own"])).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda s, t: s + t["tokens"]).alias("n_tokens"))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted window, unescaped."""

    def turn(part: Column) -> Column:
        out = None
        for name, (start, end) in _MARKS.items():
            body = F.substring(part, F.lit(len(start) + 1), F.length(part) - len(start) - len(end))
            one = F.struct(F.lit(name).alias("role"), unescape(body).alias("text"))
            out = F.when(part.startswith(start), one) if out is None else out.when(part.startswith(start), one)
        body = F.substring(part, F.lit(len(_OTHER[0]) + 1), F.length(part) - len(_OTHER[0]) - len(_OTHER[1]))
        cut = F.instr(body, "\n")
        role = unescape(F.substring(body, F.lit(1), cut - 1))
        role = F.replace(F.replace(F.replace(role, F.lit("\\\\"), F.lit("\x00")), F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))
        return out.otherwise(F.struct(role.alias("role"), unescape(F.substring(body, cut + 1, F.length(body))).alias("text")))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def chat_digest(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The digests are of a whole conversation's text, so this (unlike the windows) puts each conversation into one value.
    """
    turns = F.filter(read_turns(F.col("formatted")), lambda t, i: i >= F.col("n_repeated"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    read = windows.select("conv_id", "window", F.length("formatted").alias("chars"), F.array_join(loss, "").alias("loss"), turns.alias("turns"))
    read = read.select("conv_id", "chars", F.struct(
        "window", "loss", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
    ).alias("part"), F.size("turns").alias("n"))
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                        F.array_sort(F.collect_list("part")).alias("parts"))
    text = lambda field: F.array_join(F.transform("parts", lambda p: p[field]), "")
    return whole.select(
        "conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), F.sha2(text("said"), 256).alias("turns_sha256"),
        F.length(text("loss")).cast("bigint").alias("loss_chars"), F.sha2(text("loss"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"))
