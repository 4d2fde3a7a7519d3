"""Token ids of whole batches of texts, with each distinct word encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker keeps between batches; further words are encoded when they come.
KEPT_WORDS = 400_000
#: Texts are encoded in slices of about so many bytes.
SLICE_BYTES = 4_000_000

END_ID = 1
#: A letter and an ASCII sign behind it, other than the apostrophe, never belong to one piece.
_LETTER_SIGN = r"([a-zß-öø-ÿ])([!-&(-/:-@\[-`{-~])"
#: Words of ASCII and Latin-1 letters, lower-cased without change of length, and their pieces.
_COMMON = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: UTF-8 of these letters in the model's alphabet, where bytes without a visible sign stand above 255.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_HIDDEN = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
_ALPHABET = {
    point: "".join(chr(_HIDDEN.get(b, b)) for b in chr(point).encode()) for point in [*range(33, 127), *range(0xC0, 0x100)]
}


class Encoder:
    """Ids of the tokenizer for each text.

    The tokenizer drops white space and never joins characters across it, so the ids of a text
    are those of its space-separated words in turn. A letter and a sign behind it are cut apart
    before, and ASCII case is folded, as the tokenizer does both itself. Words of ASCII and Latin-1
    letters are cut into the tokenizer's own pieces (letters, single digits, signs, contractions),
    each of which the model encodes once; other words go through the whole tokenizer. Texts that
    contain the marks of special tokens are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Ids of kept words, one behind the other, and where each word's begin.
        self.place: dict[str, int] = {"": 0}
        self.ids, self.bounds = np.empty(0, "<u4"), np.zeros(2, np.int64)

    def _pieces(self, word: str) -> list[int]:
        found = []
        for piece in _PIECE.findall(word.lower()):
            found += [t.id for t in self.model.tokenize(piece.translate(_ALPHABET))]
        return found

    def _encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        tokenize, found, rest = self.model.tokenize, [], []
        for word in words:
            if word.isascii() and word.isalpha():
                found.append([t.id for t in tokenize(word)])
            elif _COMMON.fullmatch(word):
                found.append(self._pieces(word))
            else:
                rest.append(len(found))
                found.append([])
        encoded = self.tokenizer.encode_batch([words[k] for k in rest], add_special_tokens=False)
        for k, item in zip(rest, encoded, strict=True):
            found[k] = item.ids
        return found

    def _places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word its place in (ids, bounds), to which unknown words are added."""
        known = self.place
        places = np.array([known.get(w, -1) for w in words], np.int64)
        fresh = np.flatnonzero(places < 0)
        names = [words[k] for k in fresh]
        found = self._encode(names)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        added = np.fromiter((i for f in found for i in f), "<u4", int(sizes.sum()))
        count = len(self.bounds) - 1
        places[fresh] = count + np.arange(len(fresh))
        ids = np.concatenate([self.ids, added])
        bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        room = min(len(names), KEPT_WORDS - count)
        if room > 0:
            known.update(zip(names[:room], range(count, count + room), strict=True))
            self.bounds = bounds[: count + room + 1].copy()
            self.ids = ids[: self.bounds[-1]].copy()
        return places, ids, bounds

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (one more at the end)."""
        if pc.any(pc.match_substring(texts, "<|")).as_py():
            each = [
                np.array(x.ids, "<u4")
                for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            ]
            ends = np.cumsum([0, *map(len, each)])
            return np.concatenate([*each, np.empty(0, "<u4")]), ends
        texts = pc.replace_substring_regex(pc.ascii_lower(texts), _LETTER_SIGN, r"\1 \2")
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        places, ids, bounds = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        own = places[coded.indices.to_numpy()]
        sizes = bounds[own + 1] - bounds[own]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(bounds[own] - ends[:-1], sizes) + np.arange(ends[-1])]
        return flat, ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker, kept between tasks."""
    return Encoder(path)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``limit`` bytes with the place of their first; never splits a text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def filled(texts: pa.Array) -> pa.Array:
    """Strings without nulls."""
    return pc.fill_null(pc.cast(texts, pa.large_string()), "")
