"""Quality rules: gradient-boosted trees over document statistics.

Statistics are computed per whole text. A boosted model (logistic loss, histogram splits, depth-bounded
trees) is fitted on the statistics of at most ``SAMPLE`` labelled rows, chosen by a hash of their id; only
those numbers reach the driver. Monotonic constraints hold on the features in ``DECREASING``: more symbols,
repetition, capitals or exclamation never raise a score. The trees are flattened into node arrays (feature,
threshold, children, value), broadcast, and walked for a whole batch of documents at a time.

Defined cases: null text has no words; a text that fails the base rules (under ``MIN_WORDS`` words, or over
``MAX_REPEAT_PERCENT`` percent of words in repeated windows) is not kept; without labels, or with one label only, every
text that meets the base rules is kept. Several labels of one id count as the best one. Repeated rows are judged row by
row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_metrics.llm.tables import text_bytes

SAMPLE = 20_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
CHUNK = 1 << 20  # bytes of a text whose words are listed at a time
THRESHOLD = 0.5

FEATURES = ["n_words", "word_length", "symbols", "duplicate_lines", "repeat_words", "capitals", "digits", "exclamations",
            "distinct_words", "line_words", "echoes"]
DECREASING = ["symbols", "duplicate_lines", "repeat_words", "capitals", "exclamations", "echoes"]

_SPACE = b" \t\n\x0b\x0c\r"
_WHITE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_SYMBOLS = b"#*$%&|<>"
_NOT_WORD_START = _SPACE + bytes(range(0x80, 0xC0))  # white space and UTF-8 continuation bytes
_CAPITALS, _DIGITS, _LETTERS = (bytes(range(ord(a), ord(z) + 1)) for a, z in ("AZ", "09", "az"))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, first occurrence included."""
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    step = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(np.fromiter((counts[g] > 1 for g in grams), dtype=bool, count=len(grams)))
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def _long_text_words(text: bytes, chunk: int = CHUNK) -> np.ndarray:
    """The words of a long text as numbers, equal ones alike; listed a chunk at a time, chunks end at white space."""
    numbers: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        m = _WHITE.search(text, at + chunk)
        end = m.start() if m else len(text)
        parts.append(np.array([numbers.setdefault(w, len(numbers)) for w in text[at:end].split()], dtype=np.int32))
        at = end
    return np.concatenate(parts)


def _repeated_numbers(words: np.ndarray, window: int = WINDOW) -> int:
    """``repeated_words`` of numbered words: windows are numbered a word longer at a time."""
    if len(words) < window:
        return 0
    grams = words.astype(np.int64)
    for k in range(1, window):
        grams = np.unique((grams[:-1] << 32) + words[k:], return_inverse=True)[1].astype(np.int64)
    again = np.flatnonzero(np.bincount(grams)[grams] > 1)
    step = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(step, again, 1)
    np.add.at(step, again + window, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def text_statistics(text: bytes) -> tuple[list[int], list[float]]:
    """Base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and model features."""
    if len(text) <= CHUNK:
        words = text.split()
        n, distinct, repeats = len(words), len(set(words)), repeated_words(words)
        echoes = sum(map(bytes.__eq__, words, words[1:]))
    else:  # the same counts without a list of all words
        numbers = _long_text_words(text)
        n, distinct, repeats = len(numbers), int(numbers.max(initial=-1)) + 1, _repeated_numbers(numbers)
        echoes = int((numbers[1:] == numbers[:-1]).sum())
    without = lambda drop: len(text) - len(text.translate(None, drop))
    word_chars = len(text.translate(None, _NOT_WORD_START))
    symbols = without(_SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    duplicates = len(lines) - len(set(lines))
    capitals, letters = without(_CAPITALS), without(_LETTERS)
    base = [n, word_chars, symbols, duplicates, repeats]
    per = 1 / n if n else 0.0
    return base, [
        n, word_chars * per, symbols * per, duplicates / max(1, len(lines)), repeats * per, capitals / max(1, capitals + letters),
        without(_DIGITS) / max(1, word_chars), text.count(b"!") * per, distinct * per, n / max(1, len(lines)), echoes * per]


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])


@dataclass
class Trees:
    """Boosted trees as flat node arrays; a leaf has feature -1 and points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality for every row of ``x``."""
        rows, total = np.arange(len(x)), np.full(len(x), self.bias)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[rows, np.maximum(self.feature[node], 0)] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_split(codes, g, h, edges, signs, low, high, ridge, least):
    """The split of most gain that keeps each constrained feature's direction; None without gain."""

    def leaf(gs, hs):
        return np.clip(-gs / (hs + ridge), low, high)

    def loss(w, gs, hs):
        return gs * w + 0.5 * (hs + ridge) * w * w

    gt, ht, best = g.sum(), h.sum(), None
    whole = loss(leaf(gt, ht), gt, ht)
    for f, sign in enumerate(signs):
        size = len(edges[f]) + 1
        gl = np.cumsum(np.bincount(codes[:, f], g, size))[:-1]
        hl = np.cumsum(np.bincount(codes[:, f], h, size))[:-1]
        nl = np.cumsum(np.bincount(codes[:, f], minlength=size))[:-1]
        wl, wr = leaf(gl, hl), leaf(gt - gl, ht - hl)
        gain = whole - loss(wl, gl, hl) - loss(wr, gt - gl, ht - hl)
        ok = (nl >= least) & (len(g) - nl >= least) & ((wr - wl) * sign >= 0)
        if ok.any():
            k = int(np.argmax(np.where(ok, gain, -np.inf)))
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k, wl[k], wr[k])
    return best


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2,
              bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Histogram gradient boosting with logistic loss; ``signs`` -1, 0 or 1 constrains each feature's direction."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    total = np.full(len(y), bias)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows, g, h, level, low, high):
        me = len(nodes)
        weight = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([-1, 0.0, me, me, rate * weight])
        split = _best_split(codes[rows], g[rows], h[rows], edges, signs, low, high, ridge, least) if level else None
        if split is None:
            total[rows] += rate * weight
            return me
        _, f, k, wl, wr = split
        side = codes[rows, f] <= k
        mid = (wl + wr) / 2  # on a constrained feature both sides keep to their half below
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[f]]
        nodes[me][:2] = [f, float(edges[f][k])]
        nodes[me][2] = grow(rows[side], g, h, level - 1, *bounds[0])
        nodes[me][3] = grow(rows[~side], g, h, level - 1, *bounds[1])
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth, -np.inf, np.inf))
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
    return Trees(feature, threshold, left, right, value, np.array(roots), depth, bias)


def keep_all() -> Trees:
    """The model without evidence: every score is one half."""
    one = np.zeros(1, dtype=np.int64)
    return Trees(one - 1, np.zeros(1), one, one, np.zeros(1), one[:0], 0, 0.0)


def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([text_statistics(t)[1] for t in texts])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Model of ``labels`` (doc_id, quality) over the statistics of ``docs`` (doc_id, text).

    The sample is the ``sample`` labelled ids of least hash; that bound also bounds its broadcast.
    """
    marked = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    features = F.pandas_udf(_features, "array<double>")
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "quality", features(text_bytes()).alias("x"))
            .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))  # a repeated row counts once
            .orderBy("doc_id").toPandas())
    y = (rows["quality"].to_numpy() > 0).astype(float)
    if len(set(y)) < 2:
        return keep_all()
    return fit_trees(np.stack(rows["x"].to_numpy()), y, [-1 if f in DECREASING else 0 for f in FEATURES])


def quality_udf(spark, model: Trees, threshold: float = THRESHOLD):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
                  "base_failed boolean, kept boolean, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        found = [text_statistics(t) for t in texts]
        base = np.array([b for b, _ in found], dtype=np.int64).reshape(-1, 5)
        score = shared.value.score(np.array([x for _, x in found], dtype=float).reshape(-1, len(FEATURES)))
        out = pd.DataFrame(base, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
        out["base_failed"] = base_failed(base)
        out["kept"] = ~out["base_failed"] & (score >= threshold)
        out["score"] = score
        return out

    return judge


def judge_quality(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, base counts, base_failed, kept, score."""
    judge = quality_udf(docs.sparkSession, model, threshold)
    return docs.select("doc_id", judge(text_bytes()).alias("q")).select("doc_id", "q.*")


def keep_quality(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep; columns as given."""
    judge = quality_udf(docs.sparkSession, model, threshold)
    return docs.filter(judge(text_bytes())["kept"])
