from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from campaign_metrics.llm import simhash
from campaign_metrics.llm.components import components
from campaign_metrics.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text, k=4):
    """Bit by bit, straight from the definition."""
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\x0b\x0c\r":
            words, word = (words + [word], "") if word else (words, "")
        else:
            word += ch.lower() if "A" <= ch <= "Z" else ch
    if not words:
        return 0
    k = min(k, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i:i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, ids, max_bits):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return [least.get(find(i)) for i in range(len(prints))]


def scattered(n, seed):
    """Fingerprints in drifting clusters, with loners between them."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n // 12):
        x = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(10):
            out.append(x)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
        out += [int(rng.integers(0, 1 << 63)) for _ in range(2)]
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_is_the_definition():
    for text in ["", " \n\t", "One", "one TWO three", "a b c d", "a b c d e f g " * 60, "É é\u00a0x İ ß",
                 " ".join(map(str, range(2000)))]:
        assert simhash.fingerprint(text.encode()) == signed(plain_fingerprint(text))


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3, 4, 5, 7])
@pytest.mark.parametrize("cell_size", [3, 8192])
def test_links_connect_what_brute_force_connects(spark, max_bits, cell_size):
    prints = sorted({*scattered(240, max_bits)})
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    found = {r.node: r.component for r in components(simhash.fingerprint_links(df, max_bits, cell_size)).collect()}
    want = plain_classes(prints, [signed(x) for x in prints], max_bits)
    assert [found.get(signed(x), signed(x)) for x in prints] == want


def test_oversized_cells_are_verified_in_blocks(spark):
    rng = np.random.default_rng(1)
    prints = sorted({int(x) & 0xFF for x in rng.integers(0, 1 << 62, 400)} | {0xFFFF00000000 | int(x) for x in range(64)})
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    links = simhash.fingerprint_links(df, 2, 16)
    found = {r.node: r.component for r in components(links).collect()}
    assert [found.get(x, x) for x in prints] == plain_classes(prints, prints, 2)


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(50)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(path + star + [(7, 7), (2000, 2000), (3, 2), (None, 5)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(300)}}
    assert components(edges.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in docs]
    want = {(r.doc_id, f"{p:016x}", c) for r, p, c in zip(docs, prints, plain_classes(prints, [r.doc_id for r in docs], 4))}
    got = QUERIES["op7_simhash_near_dedup"](spark, SMALL)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {tuple(r) for r in got.collect()} == want


def test_odd_rows(spark):
    long = "word " * 30000
    rows = [(1, None, "x", 0), (2, " \n", "x", 0), (3, "same text here now ok", "x", 0), (3, "same text here now ok", "x", 0),
            (None, "same text here now ok", "x", 0), (None, "alone among all the others", "x", 0), (9, long, None, 1),
            (8, long, None, 1), (5, "SAME text here now ok", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, cell int")
    got = simhash.near_duplicate_classes(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [
        (0, 0), (0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (5, 3), (8, 8), (9, 8)]
    assert {r.fingerprint for r in got if r.doc_id in (1, 2)} == {"0" * 16}
    kept = simhash.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 8]
    assert simhash.near_duplicate_classes(docs.limit(0)).count() == 0
    assert simhash.keep_one_per_class(docs.filter(F.lit(False))).count() == 0


def test_columns_with_the_names_of_helpers_are_kept(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, 5, "k", 1, 2, "c"), (2, text, 6, "l", 3, 4, "d"), (3, "something else entirely here", 7, "m", 5, 6, "e")],
                                 "doc_id bigint, text string, _fp bigint, _KEY string, fp int, key int, class string")
    kept = simhash.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, text, 5, "k", 1, 2, "c"), (3, "something else entirely here", 7, "m", 5, 6, "e")]
