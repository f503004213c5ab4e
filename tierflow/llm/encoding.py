"""Token ids of whole texts with the tokenizers library, one encode per word.

Both public BPE vocabularies used here split a text before merging, and never
inside a run of letters.  A text is therefore cut at the start of every run of
white space that follows another character, and between a letter and an ASCII
mark of ``MARKS``; the ids of the parts, one after another, are the ids of the
text.  Names of special tokens hold no white space and none of these marks after
a letter, and get the ids that the library gives them.  Equal parts of a batch
are found by Arrow and encoded once; a bounded cache in the worker keeps them
for later batches.

Where the vocabulary marks the last id of a word, new parts that are one word of
letters are encoded many at a time, with a space between: the marks tell the ids
of each.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa

from tierflow.llm.columnar import text_bytes

# Parts of one generation of a worker's cache.  It holds two, of about 150 bytes a
# part; parts not met again while a generation fills are forgotten.
CACHED_PARTS = 250_000
# Text encoded at once: parts, places and ids of it take about twenty times its size.
ENCODED_BYTES = 2 << 20

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True

# Marks that end a run of letters: none stands in a contraction or in a special name.
MARKS = b'!"#$%&()*+,-./:;=?@'
_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# The second bytes of U+00C0 to U+00FF after 0xC3, without the signs of times and division.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_WORD = re.compile(rb"[\t\n\r ]*(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
# Words encoded as one text.
JOINED_WORDS = 1 << 10


def white_space(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to Unicode white space."""
    out = _ASCII_SPACE[data]
    if len(data) < 2 or not (data >= 0xC2).any():
        return out
    second = np.append(data[1:], np.uint8(0))
    third = np.append(data[2:], np.zeros(2, np.uint8))
    two = (data == 0xC2) & ((second == 0x85) | (second == 0xA0))
    e1 = (data == 0xE1) & (second == 0x9A) & (third == 0x80)
    e2 = (data == 0xE2) & (
        (second == 0x80)
        & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
        | (second == 0x81) & (third == 0x9F)
    )
    e3 = (data == 0xE3) & (second == 0x80) & (third == 0x80)
    three = e1 | e2 | e3
    if two.any() or three.any():
        for shift, lead in ((0, two | three), (1, two | three), (2, three)):
            at = np.flatnonzero(lead) + shift
            out[at[at < len(out)]] = True
    return out


def word_ends(data: np.ndarray) -> np.ndarray:
    """Before which bytes of UTF-8 text a mark follows a letter."""
    letter = _LETTER[data]
    if len(data) > 1 and (data == 0xC3).any():
        letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
    out = _MARK[data]
    out[1:] &= letter[:-1]
    out[:1] = False
    return out


class Encoder:
    """Encodes Arrow columns of texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.last = self._last_of_word()

    def _last_of_word(self) -> np.ndarray | None:
        """Which ids end a word, if the vocabulary tells."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        vocabulary = self.tokenizer.get_vocab()
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[i for name, i in vocabulary.items() if name.endswith(suffix)]] = True
        return out

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [
            np.array(e.ids, "<u4")
            for e in self.tokenizer.encode_batch_fast(
                [t.decode("utf-8", "replace") for t in texts], add_special_tokens=False
            )
        ]

    def _learn(self, new: list[bytes]) -> None:
        """Encode parts and remember them."""
        if self.last is not None:
            words, rest = [], []
            for part in new:
                (words if _WORD.fullmatch(part) else rest).append(part)
            for i in range(0, len(words), JOINED_WORDS):
                some = words[i : i + JOINED_WORDS]
                ids = self._encode([b" ".join(some)])[0]
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) != len(some):
                    rest += some
                    continue
                raw = ids.tobytes()
                cuts = [0, *(4 * ends).tolist()]
                self.known.update(zip(some, (raw[a:b] for a, b in pairwise(cuts)), strict=True))
            new = rest
        for i in range(0, len(new), 1 << 14):
            some = new[i : i + (1 << 14)]
            self.known.update(zip(some, (ids.tobytes() for ids in self._encode(some)), strict=True))

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHED_PARTS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        codes = list(map(known.get, parts))
        missing = [i for i, code in enumerate(codes) if code is None]
        new = []
        for i in missing:
            code = older.get(parts[i])
            if code is None:
                new.append(parts[i])
            else:
                known[parts[i]] = code
        self._learn(new)
        for i in missing:
            codes[i] = known[parts[i]]
        return codes

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and the offsets between texts."""
        data, offsets = text_bytes(column)
        space = white_space(data)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[:-1] |= word_ends(data)
        cut[offsets] = True
        at = np.flatnonzero(cut)
        parts = pa.Array.from_buffers(
            pa.large_binary(),
            len(at) - 1,
            [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
        ).dictionary_encode()
        codes = pa.array(self._parts(parts.dictionary.to_pylist()), pa.large_binary())
        _, ends, raw = codes.take(parts.indices).buffers()
        ends = np.frombuffer(ends, np.int64, len(at)) >> 2
        flat = np.frombuffer(raw or b"", "<u4", ends[-1])
        bounds = ends[np.searchsorted(at, offsets)]
        if end is None:
            return flat, bounds
        flat = np.insert(flat, bounds[1:], end)
        return flat, bounds + np.arange(len(bounds))


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)
