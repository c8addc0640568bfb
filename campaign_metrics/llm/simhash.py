"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint has bit i set when over half of its shingles' XXH64 (seed 42) have it. For search,
a fingerprint becomes the vector of its bit counts in 2-bit segments. Two fingerprints that differ
in d bits have vectors at Manhattan distance of at most d, so vector distance bounds bit distance
from below and every link survives the range-join:

* the vector is split in two halves; a pair within distance 4 has distance <= 2 in the first half or
  <= 1 in the second (more than that in both adds up to more than 4);
* the grid has a cell for each integer vector of a half. Points at distance <= 2 share a cell within
  distance 1 of both, so a fingerprint enters its own cell and the cells one step away. The same
  cells cover distance <= 1 in the second half.

General ``max_bits`` works alike: each half gets the radius that the sum needs. Members of one cell
are verified by exact bit distance. A task walks its cells in key order and keeps a spanning
forest of the links that it verified instead of all pairs, which loses no connection. A cell of
more than ``CELL`` fingerprints is passed on in blocks of that size and verified block against block
in tasks of their own, so no task holds an unbounded cell.

Only distinct fingerprints enter the search: a group of exact copies is one point.

Defined cases: null or wordless text has fingerprint zero, linked like any other; a text of fewer words
than a shingle is one shingle; equal fingerprints are one class; repeated rows and repeated ids are
rows of the same class; a null id gets its class's least id (null where all are null); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_metrics.llm.components import components
from campaign_metrics.llm.tables import free_name, text_bytes, written

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SEGMENT_BITS = 2
CELL = 8192
NEAR = 32  # cells up to this size are compared by shifted rows, larger ones member by member

_NO_ID = -(1 << 63)  # stands for a null doc_id in join keys
_LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each of the 64 bits: eight byte lanes are summed at a time."""
    counts = np.zeros((8, 8), dtype=np.int64)  # [shift, byte]
    for i in range(0, len(hashes), 255):
        part = hashes[i:i + 255]
        for shift in range(8):
            lanes = ((part >> np.uint64(shift)) & _LANES).sum(dtype=np.uint64)
            counts[shift] += np.frombuffer(np.array([lanes], dtype="<u8").tobytes(), dtype=np.uint8)
    return counts.T.reshape(64)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of UTF-8 ``text``."""
    words = text.lower().split()  # bytes: only A-Z and only the six ASCII white-space characters
    if not words:
        return 0
    k = min(shingle_words, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())], dtype=np.uint64)
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint_udf(shingle_words: int = SHINGLE_WORDS):
    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle_words) for t in texts], dtype="int64")

    return fp


def segment_vectors(fps: np.ndarray) -> np.ndarray:
    """(n, 32) bit counts of the 2-bit segments."""
    x = fps.view(np.uint64)
    shifts = np.arange(0, 64, SEGMENT_BITS, dtype=np.uint64)
    return np.bitwise_count((x[:, None] >> shifts) & np.uint64(3)).astype(np.int8)


def _steps(rows: np.ndarray, cells: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every cell one step from each given cell, inside the grid."""
    out = []
    for axis in range(vectors.shape[1]):
        weight = np.int64(1) << np.int64(2 * axis)
        for step, ok in ((1, vectors[:, axis] < SEGMENT_BITS), (-1, vectors[:, axis] > 0)):
            moved = vectors[ok].copy()
            moved[:, axis] += step
            out.append((rows[ok], cells[ok] + step * weight, moved))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def grid_cells(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell key) of every cell that each fingerprint enters.

    Keys hold two bits per segment (32 bits for a half) and the half in bit 32. A half whose range is r
    takes the cells within ceil(r / 2) steps, so that any two points in range share one.
    """
    first, second = max_bits // 2, max_bits - max_bits // 2 - 1
    vectors, half = segment_vectors(fps), 32 // SEGMENT_BITS
    all_rows, all_keys = [], []
    for side, reach in ((0, first), (1, second)):
        if reach < 0:
            continue
        v = vectors[:, side * half:(side + 1) * half]
        cells = (v.astype(np.int64) << (2 * np.arange(half, dtype=np.int64))).sum(axis=1)
        rows, seen = np.arange(len(fps)), None
        reached = [(rows, cells, v)]
        for _ in range(-(-reach // 2)):
            reached.append(_steps(*reached[-1]))
        seen = np.stack([np.concatenate([r for r, _, _ in reached]), np.concatenate([c for _, c, _ in reached])], axis=1)
        if len(reached) > 2:  # more than one step comes back to cells already entered
            seen = np.unique(seen, axis=0)
        all_rows.append(seen[:, 0])
        all_keys.append(seen[:, 1] + (np.int64(side) << np.int64(32)))
    return np.concatenate(all_rows), np.concatenate(all_keys)


def _place(max_bits: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for i in range(0, len(fps), 4096):
                rows, keys = grid_cells(fps[i:i + 4096], max_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(fps[i:i + 4096][rows])], names=["cell", "fp"])

    return place


class Forest:
    """Union-find over fingerprints; ``edges`` lists a spanning forest."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        root = x
        while (up := p.get(root, root)) != root:
            root = up
        while x != root:
            p[x], x = root, p.get(x, x)
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in list(self.parent)]


def link_cell(members: np.ndarray, max_bits: int, forest: Forest) -> None:
    """Link all of a cell's members that connect at ``max_bits`` or fewer differing bits.

    Breadth-first: a member is compared with those not yet reached, so a tight group costs few comparisons.
    """
    left = np.unique(members).view(np.uint64)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found = left[near]
                for y in found.view(np.int64).tolist():
                    forest.link(int(x.view(np.int64)), y)
                queue.extend(found)
                left = left[~near]


def link_sorted(keys: np.ndarray, fps: np.ndarray, max_bits: int, forest: Forest) -> None:
    """Link inside every run of equal ``keys`` (sorted)."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    for i in np.flatnonzero(sizes > NEAR):
        link_cell(fps[starts[i]:starts[i] + sizes[i]], max_bits, forest)
    small = np.repeat(sizes <= NEAR, sizes)
    bits = fps.view(np.uint64)
    for shift in range(1, min(NEAR, int(sizes.max(initial=0)))):
        same = (keys[shift:] == keys[:-shift]) & small[shift:]
        at = np.flatnonzero(same)
        if not len(at):
            break
        near = at[np.bitwise_count(bits[at] ^ bits[at + shift]) <= max_bits]
        for a, b in zip(fps[near].tolist(), fps[near + shift].tolist()):
            forest.link(a, b)


def _verify(max_bits: int, cell_size: int):
    """Rows (u, v, cell, block): a link (cell null), or a member of an oversized cell (v null)."""
    names, none = ["u", "v", "cell", "block"], lambda n: pa.nulls(n, pa.int64())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, keys, fps = Forest(), np.empty(0, np.int64), np.empty(0, np.int64)
        hot, sent = None, 0  # the oversized cell being passed on, and how many members went

        def members(cell: int, part: np.ndarray) -> pa.RecordBatch:
            nonlocal sent
            block = (sent + np.arange(len(part))) // cell_size
            sent += len(part)
            return pa.RecordBatch.from_arrays(
                [pa.array(part), none(len(part)), pa.array(np.full(len(part), cell)), pa.array(block)], names=names)

        for batch in batches:
            keys = np.r_[keys, batch.column("cell").to_numpy()]
            fps = np.r_[fps, batch.column("fp").to_numpy()]
            if hot is not None:
                n = int(np.searchsorted(keys, hot, side="right"))
                if n:
                    yield members(hot, fps[:n])
                keys, fps = keys[n:], fps[n:]
                if len(keys):
                    hot = None
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1], side="left"))  # the last cell may go on
            link_sorted(keys[:last], fps[:last], max_bits, forest)
            keys, fps = keys[last:], fps[last:]
            if len(keys) > cell_size:
                hot, sent = int(keys[0]), 0
                yield members(hot, fps)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            link_sorted(keys, fps, max_bits, forest)
        if found := forest.edges():
            u, v = (np.array(x, dtype=np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none(len(u)), none(len(u))], names=names)

    return verify


def _verify_blocks(max_bits: int):
    def verify(key, pdf: pd.DataFrame) -> pd.DataFrame:
        forest = Forest()
        link_cell(pdf["u"].to_numpy(), max_bits, forest)
        return pd.DataFrame(forest.edges(), columns=["u", "v"]).astype("int64")

    return verify


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, cell_size: int = CELL) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (fp long) that connect all links of ``max_bits`` or fewer bits."""
    if not 0 <= max_bits <= 64:
        raise ValueError("max_bits must be between 0 and 64")
    cells = fps.select("fp").mapInArrow(_place(max_bits), "cell bigint, fp bigint")
    found = written(
        cells.repartition("cell").sortWithinPartitions("cell")
        .mapInArrow(_verify(max_bits, cell_size), "u bigint, v bigint, cell bigint, block bigint"), "simhash-links")
    members = found.filter("cell is not null").select("cell", "block", "u")
    blocks = members.groupBy("cell").agg(F.max("block").alias("top"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))).alias("other")
    pairs = members.join(blocks, "cell").select("cell", "block", "u", other)
    linked = pairs.groupBy("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).applyInPandas(
        _verify_blocks(max_bits), "u bigint, v bigint")
    return found.filter("cell is null").select("u", "v").union(linked)


def _classes(prints: DataFrame, max_bits: int, cell_size: int) -> DataFrame:
    """fp, class (least linked fp) and component_id of every distinct fingerprint of ``prints`` (doc_id, fp)."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = components(fingerprint_links(distinct.select("fp"), max_bits, cell_size))
    labelled = distinct.join(links, distinct.fp == links.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("class"))
    # written, so that both sides of the join come as they are dealt: a class that holds many is then split over tasks
    labelled = written(labelled, "simhash-classes")
    ids = written(labelled.groupBy("class").agg(F.min("least").alias("component_id")), "simhash-class-ids")
    return labelled.join(ids, "class").select("fp", "class", "component_id")


def near_duplicate_classes(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                           cell_size: int = CELL) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    prints = written(docs.select("doc_id", fingerprint_udf(shingle_words)(text_bytes()).alias("fp")), "simhash")
    classes = _classes(prints, max_bits, cell_size)
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_class(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                       cell_size: int = CELL) -> DataFrame:
    """``docs`` with one row of every class: the one of least doc_id (a named row before an unnamed one).

    Columns as given. Repeated rows of that id leave one row. The texts move once, to meet the list of rows
    to keep; that list is spread by (fingerprint, id), so a large group of copies has no hot key.
    """
    fp, key = free_name(docs, "_fp"), free_name(docs, "_key")
    marked = written(docs.withColumns({
        fp: fingerprint_udf(shingle_words)(text_bytes()), key: F.coalesce("doc_id", F.lit(_NO_ID))}), "simhash-docs")
    prints = marked.select("doc_id", F.col(fp).alias("fp"), F.col(key).alias("key"))
    classes = _classes(prints, max_bits, cell_size)
    keep = (prints.join(classes, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("class", F.col("key").alias(key)).agg(F.min("fp").alias(fp)).select(fp, key))
    return marked.join(keep, [fp, key], "left_semi").dropDuplicates([fp, key]).drop(fp, key).select(*[f"`{c}`" for c in docs.columns])
