"""Best-fit packing of token sequences by hierarchical residual packing.

1. Each input partition encodes its documents and cuts those longer than ``CAPACITY`` tokens into pieces.
   The pieces (ids and numbers, no texts) are written, and dealt evenly over as many leaves as there were
   partitions, or more so that none has over ``LOCAL_ITEMS``: every leaf sees the mix of lengths, however
   the input was laid out. A leaf packs its pieces by best fit in decreasing length. Bins with at most
   ``SLACK`` free tokens are emitted.
2. The leaves are those of a tree of fan-in ``FAN_IN``. In every round the underfull bins of
   sibling nodes meet as items (a bin moves whole) and are packed by best fit again; nearly full bins are
   emitted. Two bins of one node that are both at most half full always merge, so a node passes
   on at most one such bin. Of the other underfull bins only the ``PARTNERS`` emptiest move on,
   more than the siblings' small bins can use; the rest are emitted. So a node holds a bounded number
   of bins at any input size, the root included.

Rounds exchange one row per bin; the pieces of bins that merged are renumbered by a join on the bin. Every
round is written to the shared folder.

Defined cases: null and empty texts are the single end token; repeated rows and null ids are packed row by
row; a text longer than the capacity is cut, nothing is dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_metrics.llm.tables import text_bytes, written
from campaign_metrics.llm.tokens import encoder, public_path

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
SLACK = 16
FAN_IN = 8
PARTNERS = 64
LOCAL_ITEMS = 100_000  # pieces that one leaf packs at a time

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int"
SCHEMA = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, "
          "offset bigint, fill bigint, node bigint, done boolean")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit in decreasing length: bin and offset of every item, fill of every bin.

    ``open_`` has bit r set while some bin has r free tokens, so the tightest fit for a length is the lowest
    set bit from that length on.
    """
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, count = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_ >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                open_ ^= 1 << free
        else:
            free, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - free
        by_free[free - size].append(b)
        open_ |= 1 << (free - size)
    fill = np.zeros(count, dtype=np.int64)
    np.add.at(fill, bins, lengths)
    return bins, offsets, fill


def _finished(fill: np.ndarray, capacity: int, slack: int, partners: int) -> np.ndarray:
    """Bins to emit: nearly full ones, and all but the emptiest ``partners`` of those over half full."""
    done = fill >= capacity - slack
    stuck = np.flatnonzero(~done & (2 * fill > capacity))
    if len(stuck) > partners:
        done[stuck[np.argsort(fill[stuck], kind="stable")[partners:]]] = True
    return done


def _cut_partition(path: str, capacity: int):
    """The pieces of a partition's documents, with the partition's number."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(path)
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_buffer().to_pybytes()) + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at:at + 4 * capacity]
                    found.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), part))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    return cut


def _pack_leaf(capacity: int, slack: int, partners: int, local_items: int):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows(table: pa.Table, node: int, first_bin: int) -> tuple[Iterator[pa.RecordBatch], int]:
        bins, offset, fill = best_fit(table.column("length").to_numpy(), capacity)
        done = _finished(fill, capacity, slack, partners)
        more = [(node << 40) + first_bin + bins, offset, fill[bins], np.full(len(bins), node), done[bins]]
        out = pa.Table.from_arrays([*table.columns, *map(pa.array, more)], names=names)
        return out.to_batches(), first_bin + len(fill)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, next_bin, found, count = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            found.append(batch)
            count += batch.num_rows
            while count >= local_items:
                table = pa.Table.from_batches(found)
                out, next_bin = rows(table.slice(0, local_items), node, next_bin)
                yield from out
                found, count = table.slice(local_items).to_batches(), count - local_items
        if count:
            yield from rows(pa.Table.from_batches(found), node, next_bin)[0]

    return pack


def _merge(capacity: int, slack: int, partners: int, last: bool):
    """Best fit of a node's bins as items: bin -> merged bin, shift inside it, its fill, whether it is emitted."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence_id", ignore_index=True)
        bins, shift, fill = best_fit(pdf["fill"].to_numpy(), capacity)
        done = np.full(len(fill), True) if last else _finished(fill, capacity, slack, partners)
        head = np.empty(len(fill), dtype=np.int64)
        first = shift == 0  # the item that opened the bin names it
        head[bins[first]] = pdf["sequence_id"].to_numpy()[first]
        return pd.DataFrame({"sequence_id": pdf["sequence_id"], "into": head[bins], "shift": shift, "fill": fill[bins],
                             "node": pdf["node"], "done": done[bins]})

    return merge


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, slack: int = SLACK, fan_in: int = FAN_IN,
         partners: int = PARTNERS, local_items: int = LOCAL_ITEMS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` has doc_id and text; ``tokenizer`` is the path of a tokenizers file that drops white space.
    """
    if partners < fan_in:
        raise ValueError("partners must be at least fan_in")
    path = tokenizer or public_path(TOKENIZER)
    pieces = written(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
        .mapInArrow(_cut_partition(path, capacity), PIECES), "packing")
    last, count = pieces.agg(F.max("part"), F.count(F.lit(1))).first()
    leaves = max((last or 0) + 1, -(-count // local_items))  # a leaf's pieces are packed at one time, so that they are mixed
    todo = written(pieces.drop("part").repartition(leaves).mapInArrow(_pack_leaf(capacity, slack, partners, local_items), SCHEMA), "packing")
    emitted = [todo.filter("done")]
    nodes = (todo.agg(F.max("node")).first()[0] or 0) + 1
    while True:
        carried = todo.filter("not done").withColumn("node", F.floor(F.col("node") / fan_in))
        nodes = -(-nodes // fan_in)
        merged = carried.filter("offset = 0").select("sequence_id", "fill", "node").groupBy("node").applyInPandas(
            _merge(capacity, slack, partners, nodes == 1),
            "sequence_id bigint, into bigint, shift bigint, fill bigint, node bigint, done boolean")
        todo = written(
            carried.drop("fill", "node", "done").join(merged, "sequence_id").select(
                "doc_id", "piece", "start", "length", "ids_crc32", F.col("into").alias("sequence_id"),
                (F.col("offset") + F.col("shift")).alias("offset"), "fill", "node", "done"), "packing")
        emitted.append(todo.filter("done"))
        if nodes == 1:
            break
    out = emitted[0]
    for more in emitted[1:]:
        out = out.unionByName(more)
    return out.drop("fill", "node", "done")
