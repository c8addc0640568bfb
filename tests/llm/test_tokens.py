"""Token ids of whole texts against the tokenizer's own chain."""

import random
import string

import numpy as np
import pyarrow.parquet as pq
import pytest

from campaign_metrics.llm.tokens import _PLAIN, WordEncoder, public_path

PATH = public_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encode():
    return WordEncoder(PATH)


def _differing(encode, texts):
    chain = encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return [t for t, e in zip(texts, chain) if encode(t.encode()) != np.array(e.ids, dtype="<u4").tobytes()]


def test_every_plain_character(encode):
    plain = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and _PLAIN.fullmatch(chr(c))]
    assert encode.folding and len(plain) > 20_000
    for a, b in (("", ""), ("x", "Y"), ("1", "'s"), ("!", "'LL")):
        assert _differing(encode, [a + c + b for c in plain]) == []


def test_odd_words_and_special_tokens(encode):
    marked = [c + chr(m) for c in string.ascii_letters for m in range(0x300, 0x370)]
    odd = ["", " ", "<|endoftext|>", "a<|ENDOFTEXT|>b", "x<|startoftext|>Y", "<|", "İstanbul", "ΣΊΣΥΦΟΣ", "각", "a\x1cb\x85c", "x y",
           "a b", "’s it’s", "日本語 text", "😀 smile", "don't DON'T 'twas '", "A" * 5000, "é" * 200]
    assert _differing(encode, marked + odd) == []


def test_random_mixtures_with_a_small_cache():
    encode = WordEncoder(PATH, cache_pieces=50)
    rng = random.Random(3)
    letters = [*string.printable, "'", "'s", "é", "É", "Ж", "中", "İ", "́", "’", "<|", "|>", "endoftext", "<|endoftext|>"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(5000)]
    assert _differing(encode, texts) == []
    assert len(encode.pieces.young) <= 50 and len(encode.pieces.old) <= 50


def test_all_documents(encode):
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t is not None]
    assert _differing(encode, texts) == []


def test_byte_level_file_takes_the_whole_chain():
    encode = WordEncoder(public_path("byte_bpe_50k.json"))
    assert not encode.folding
