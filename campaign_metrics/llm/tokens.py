"""Token ids by a public tokenizer file, piece by piece through bounded caches.

A tokenizer that drops white space never joins characters across it, so a text's ids are those of its white-space
separated words in order. If the file also lower-cases and splits words as ``_FOLDING`` says, a cheaper way opens for
text whose characters are all in ``_PLAIN``: it is folded and split here into pieces (a run of letters, a digit, a run of
signs), whose ids the BPE model gives directly. Pieces repeat far more than words: ``"Rain,``, ``rain`` and ``rain.``
share one. Words with any other character, and texts that hold a special token, take the tokenizer's whole chain.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np

CACHE_PIECES = 500_000  # of a generation
LONGEST_CACHED = 64  # characters

# The pattern of the tokenizer files that the cheaper way fits, as it stands in them.
_FOLDING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same pattern over lower-cased plain characters: ASCII, and Latin-1, Latin Extended-A, Cyrillic and CJK letters and
# general punctuation, which the normal form leaves alone and which are lower-cased one by one.
_LETTERS = "a-zß-öø-ÿĀ-ſа-џ一-鿋"
_SPLIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_PLAIN = re.compile("[ \t\n\v\f\r!-~À-įı-ſЀ-џ\u2010-\u2027\u2030-\u205e一-鿋]*")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Recent:
    """A dictionary bounded by age: it holds the last ``size`` additions or uses at least, and twice as many at most."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def older(self, key: str) -> bytes | None:
        """The value of a key that is not young; it is young again from then on."""
        value = self.old.get(key)
        if value is not None:
            self.add(key, value)
        return value

    def add(self, key: str, value: bytes) -> None:
        if len(key) > LONGEST_CACHED:
            return
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class WordEncoder:
    """Ids of whole texts for a tokenizer that drops white space, as packed little-endian uint32."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces, self.words = _Recent(cache_pieces), _Recent(cache_pieces)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.special = [t["content"] for t in parts["added_tokens"]]
        folds = ((parts["normalizer"] or {}).get("normalizers") or [{}])[-1]
        splits = ((parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.folding = folds.get("type") == "Lowercase" and splits.get("pattern") == {"Regex": _FOLDING}
        # The byte alphabet of byte-level models: printable bytes stand for themselves, the others follow from 256 on.
        itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in itself)}

    def _chain(self, words: list[str]) -> list[bytes]:
        """Ids of words by the whole chain; those not in the cache are encoded together."""
        ids = {w: i for w in words if (i := self.words.young.get(w) or self.words.older(w)) is not None}
        new = list({w for w in words if w not in ids})
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            ids[w] = np.array(e.ids, dtype="<u4").tobytes()
            self.words.add(w, ids[w])
        return [ids[w] for w in words]

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.young.get(piece) or self.pieces.older(piece)
        if ids is None:
            signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(signs)])
            self.pieces.add(piece, ids)
        return ids

    def _plain(self, text: str) -> list[bytes]:
        pieces = _SPLIT.findall(text.lower())
        ids = [*map(self.pieces.young.get, pieces)]
        return ids if None not in ids else [self._piece(p) if i is None else i for p, i in zip(pieces, ids)]

    def _mixed(self, words: list[str]) -> Iterable[bytes]:
        odd = iter(self._chain([w for w in words if not _PLAIN.fullmatch(w)]))
        return (b"".join(self._plain(w)) if _PLAIN.fullmatch(w) else next(odd) for w in words)

    def __call__(self, text: bytes) -> bytes:
        said = text.decode()
        if not self.folding or any(s in said for s in self.special):
            return b"".join(self._chain([w.decode() for w in text.split()]))
        if _PLAIN.fullmatch(said):
            return b"".join(self._plain(said))
        return b"".join(self._mixed([w.decode() for w in text.split()]))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
