"""Packing by non-negative least squares over the histogram of lengths.

1. Each partition encodes its documents, cuts them every ``CAPACITY`` tokens and writes the pieces. A full piece is a
   sequence of its own; what is left of a document is shorter than the window. The histogram of those lengths has less than
   ``CAPACITY`` counts at any input size.
2. The mixes of at most ``DEPTH`` lengths that fill a window exactly are enumerated. How often to repeat each of them is
   a non-negative least-squares problem: repeats times mixes shall equal the histogram. It is solved by projected
   gradients with momentum, rounded down, and the fractions are spent largest first, as far as there are pieces left.
3. A piece's number among those of its length (its place in its partition and the partitions before) says which copy of
   which mix it joins: the places are ranges of such numbers, a table bounded by the number of mixes.
4. The pieces that no mix takes are the last of their length, so a partition and a place for each length tell them from
   the others. They are dealt over tasks of about ``GROUP_TOKENS`` tokens. A task fills window after window with the
   longest piece that fits; where none fits, a piece is cut to close the window. Its last, partly filled window is cut into
   parts whose lengths are powers of two.

So no sequence is padded. A document is cut at its windows, and at most about one piece a window in step 4.

Defined cases: null and empty texts are the end token alone; repeated rows and null ids are packed row by row; further
columns are ignored; nothing is dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campaign_metrics.llm.tables import text_bytes, written
from campaign_metrics.llm.tokens import encoder, public_path

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
DEPTH = 3
STEPS = 150
GROUP_TOKENS = 1 << 22
BATCH_TOKENS = 1 << 20

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, nth bigint, ids binary")
PLACED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
# Sequences are numbered from these on: mixes from 0, windows of step 4 and full pieces by task.
LEFT, FULL = 1 << 61, 1 << 62


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def mixes_filling(window: int, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Every multiset of at most ``depth`` of ``lengths`` that adds up to ``window``: rows in falling order, zeros at the end."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths[lengths <= window]] = True
    have[0] = True
    usable = np.flatnonzero(have)
    found = np.empty((1, 0), dtype=np.int64)
    rest, last = np.array([window]), np.array([window])
    for k in range(depth, 1, -1):  # k parts are still to come, none above the last one
        low = np.searchsorted(usable, -(-rest // k))
        high = np.searchsorted(usable, np.minimum(rest, last), side="right")
        many = np.maximum(high - low, 0)
        row = np.repeat(np.arange(len(rest)), many)
        part = usable[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]]
        found, rest, last = np.c_[found[row], part], rest[row] - part, part
    ok = have[rest] & (rest <= last)
    return np.c_[found, rest][ok]


def _lengths_used(mixes: np.ndarray, repeats: np.ndarray, size: int) -> np.ndarray:
    used = np.zeros(size, dtype=repeats.dtype)
    for part in mixes.T:
        used += np.bincount(part, repeats, minlength=size).astype(repeats.dtype, copy=False)
    used[0] = 0  # no length
    return used


def least_squares_repeats(mixes: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats (not negative) of ``mixes`` whose lengths come nearest to ``histogram`` in least squares.

    Projected gradient steps with momentum, which starts anew whenever it points uphill.
    """
    def gain(by_length):
        return by_length[mixes].sum(axis=1)

    def used(repeats):
        return _lengths_used(mixes, repeats, len(histogram))

    steep, top = np.ones(len(mixes)), 0.0
    for _ in range(20):  # the largest curvature, by power iteration
        steep = gain(used(steep))
        top = np.linalg.norm(steep)
        steep /= top
    x = ahead = np.zeros(len(mixes))
    pace = 1.0
    for _ in range(steps):
        new = np.maximum(0, ahead - gain(used(ahead) - histogram) / (1.05 * top))
        if ((ahead - new) * (new - x)).sum() > 0:
            pace = 1.0
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, x, pace = new + (pace - 1) / faster * (new - x), new, faster
    return x


def whole_repeats(mixes: np.ndarray, wanted: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeats that the histogram has the pieces for: ``wanted`` rounded down, then one or more by falling fraction."""
    left = histogram.astype(np.int64).tolist()
    out = np.zeros(len(mixes), dtype=np.int64)
    down = np.floor(wanted).astype(np.int64)
    by_fraction = np.argsort(down - wanted, kind="stable")
    by_count = np.argsort(-down, kind="stable")[:np.count_nonzero(down)]
    parts = mixes.tolist()
    for order, most in ((by_count, down[by_count].tolist()), (by_fraction, [1] * len(mixes)), (by_fraction, [max(left)] * len(mixes))):
        for s, some in zip(order.tolist(), most):
            mix = [p for p in parts[s] if p]
            for p in mix:
                some = min(some, left[p] // mix.count(p))
                if not some:
                    break
            else:
                out[s] += some
                for p in mix:
                    left[p] -= some
    return out


class Places(NamedTuple):
    """Where the pieces of each length go. ``used[l]`` pieces of length l join mixes; those with numbers from ``first`` on,
    ``key`` being (l << 40) + first, up to the next key go to the sequences from ``sequence`` on, each at ``offset``."""

    used: np.ndarray
    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def plan(histogram: np.ndarray, depth: int = DEPTH, steps: int = STEPS) -> Places:
    """Places for ``histogram`` (counts of the lengths 0 to the window)."""
    window = len(histogram) - 1
    mixes = mixes_filling(window, np.flatnonzero(histogram), depth)
    repeats = np.zeros(0, dtype=np.int64)
    if len(mixes):
        repeats = whole_repeats(mixes, least_squares_repeats(mixes, histogram.astype(float), steps), histogram)
        mixes, repeats = mixes[repeats > 0], repeats[repeats > 0]
    sequence = np.cumsum(repeats) - repeats
    offset = np.cumsum(mixes, axis=1) - mixes
    length, times = mixes.ravel(), np.repeat(repeats, mixes.shape[1])
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    length, times = length[order], times[order]
    before = np.cumsum(times) - times  # pieces in places so far, then only those of the same length
    first = before - before[np.searchsorted(length, length)] if len(length) else before
    return Places(_lengths_used(mixes, repeats, window + 1), (length << 40) + first, first,
                  np.repeat(sequence, mixes.shape[1])[order], offset.ravel()[order])


def _cut_partition(path: str, capacity: int, batch_tokens: int):
    """The pieces of a partition's documents; ``nth`` counts those of one length. Only pieces below the window keep their ids."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, seen = TaskContext.get().partitionId(), encoder(path), [0] * (capacity + 1)
        for batch in batches:
            found, held = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_buffer().to_pybytes()) + END_ID.to_bytes(4, "little")
                tokens = len(ids) // 4
                for at in range(0, tokens, capacity):
                    piece = ids[4 * at:4 * (at + capacity)]
                    n = len(piece) // 4
                    found.append((doc_id, at, n, zlib.crc32(piece), tokens, part, seen[n], piece if n < capacity else None))
                    seen[n] += 1
                held += tokens
                if held >= batch_tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=_names(PIECES))
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=_names(PIECES))

    return cut


def _join_mixes(shared):
    """Sequence and offset of pieces by length and number; those beyond the places are left out."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            kept = number < places.used[length]
            batch, length, number = batch.filter(pa.array(kept)), length[kept], number[kept]
            at = np.searchsorted(places.key, (length << 40) + number, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in _names(PLACED)[:5]), pa.array(places.sequence[at] + number - places.first[at]),
                 pa.array(places.offset[at])], names=_names(PLACED))

    return join


def fill_windows(lengths: list[int], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (item, start, length), each filled by the longest parts that fit; a part is cut where none does.

    The last one is cut into powers of two, so that every list yielded holds ``window`` or a power of two.
    """
    by_length: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]
    for item, n in enumerate(lengths):
        by_length[n].append((item, 0))
    open_ = sum(1 << n for n in range(1, window + 1) if by_length[n])  # bit n: there is a part of length n

    def put(n: int, part: tuple[int, int]) -> None:
        nonlocal open_
        by_length[n].append(part)
        open_ |= 1 << n

    while open_:
        held, free = [], window
        while free and open_:
            fits = open_ & ((2 << free) - 1)
            n = (fits or open_).bit_length() - 1
            item, start = by_length[n].pop()
            if not by_length[n]:
                open_ ^= 1 << n
            if n > free:
                put(n - free, (item, start + free))
                n = free
            held.append((item, start, n))
            free -= n
        if free:
            yield from _powers_of_two(held, window - free)
        else:
            yield held


def _powers_of_two(held: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    parts = held[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out = []
        while size:
            item, start, n = parts.pop()
            if n > size:
                parts.append((item, start + size, n - size))
                n = size
            out.append((item, start, n))
            size -= n
        yield out


def _fill_left(window: int, group_tokens: int):
    types = [pa.int64()] * 7

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, rows, held = LEFT + (TaskContext.get().partitionId() << 32), 0, [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal made, rows, held
            out = []
            for sequence in fill_windows([len(r["ids"]) // 4 for r in rows], window):
                offset = 0
                for item, start, n in sequence:
                    r = rows[item]
                    crc = zlib.crc32(r["ids"][4 * start:4 * (start + n)])
                    out.append((r["doc_id"], r["start"] + start, n, crc, r["doc_tokens"], base + made, offset))
                    offset += n
                made += 1
            rows, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=_names(PLACED))

        for batch in batches:
            for r in batch.to_pylist():
                rows.append(r)
                held += len(r["ids"]) // 4
                if held >= group_tokens:
                    yield from packed()
        yield from packed()

    return fill


def pack_by_histogram(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, depth: int = DEPTH,
                      steps: int = STEPS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id and text; ``tokenizer`` is the path of a tokenizers file that drops white space. The number of mixes
    grows with ``capacity`` to the power ``depth`` - 1 (about 350,000 at 2048 and 3).
    """
    spark = docs.sparkSession
    path = tokenizer or public_path(TOKENIZER)
    pieces = written(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
        .mapInArrow(_cut_partition(path, capacity, BATCH_TOKENS), PIECES), "nnls-pieces")
    short = pieces.filter(F.col("length") < capacity)
    # pieces of a length in a partition, and in those before it: a row for each, never for each piece
    counts = written(short.groupBy("length", "part").agg(F.count(F.lit(1)).alias("count")), "nnls-counts")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # fewer than capacity rows
        histogram[r.length] = r.n
    places = plan(histogram, depth, steps)

    shared = spark.sparkContext.broadcast(places)
    placed = (short.drop("ids").join(numbered.select("length", "part", "before"), ["length", "part"])
              .withColumn("number", F.col("nth") + F.col("before")).select(*_names(PLACED)[:5], "number")
              .mapInArrow(_join_mixes(shared), PLACED))

    # the partition and the place in it from which on no mix takes the pieces of a length: one row for each length
    limits = spark.createDataFrame([(n, int(u)) for n, u in enumerate(places.used) if histogram[n] > u], "length bigint, used bigint")
    ends = (numbered.join(F.broadcast(limits), "length").filter("before <= used and used < before + count")
            .select("length", F.col("part").alias("end_part"), (F.col("used") - F.col("before")).alias("end_nth")))
    left = (short.join(F.broadcast(ends), "length").filter("part > end_part or (part = end_part and nth >= end_nth)")
            .select("doc_id", "start", "doc_tokens", "ids"))
    tokens = int((np.arange(capacity + 1) * (histogram - places.used)).sum())
    left = left.repartition(max(1, -(-tokens // group_tokens))).mapInArrow(_fill_left(capacity, group_tokens), PLACED)

    whole = pieces.filter(F.col("length") == capacity).select(
        *_names(PLACED)[:5], (F.lit(FULL) + F.shiftleft(F.col("part").cast("bigint"), 32) + F.col("nth")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"))
    return whole.unionByName(placed).unionByName(left)
