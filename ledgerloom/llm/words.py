"""Texts as arrays of 64-bit word hashes, for the operators that run in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words whose terms a worker remembers; beyond, it forgets all and starts again.
CACHE_WORDS = 200_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MARKS = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
#: Bytes from which a word is hashed by itself.
LONG_WORD = 64


def normal_word(word: str) -> str:
    """Lower case, without marks at either end; a word of marks alone is gone."""
    if not (word[0].isalnum() and word[-1].isalnum()):
        word = _EDGE.sub("", word)
    return word.lower()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def string_hashes(words: pa.StringArray) -> np.ndarray:
    """64-bit hashes of strings, never 0; that of the empty string is 0.

    All words are hashed together, one place after the other; the few long ones by xxhash.
    """
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(ends)
    order = np.argsort(-size, kind="stable")
    down, start = size[order], ends[:-1][order]
    h = down.astype(np.uint64) * _MIX
    for k in range(min(int(down[0]) if len(down) else 0, LONG_WORD)):
        n = np.searchsorted(-down, -k)  # words of more than k bytes
        x = (h[:n] ^ raw[start[:n] + k]) * _MIX
        h[:n] = x ^ (x >> np.uint64(32))
    for i in range(np.searchsorted(-down, -LONG_WORD)):
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + down[i]])
    out = np.empty(len(words), np.uint64)
    out[order] = np.where(down == 0, np.uint64(0), np.maximum(mix64(h), np.uint64(1)))
    return out


class WordHasher:
    """Hashes of words in lower case without marks at either end; words of marks alone are left out."""

    _kept: WordHasher | None = None

    @classmethod
    def of(cls) -> WordHasher:
        if cls._kept is None:
            cls._kept = cls()
        return cls._kept

    def __call__(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words one after the other, offsets of the texts in them)."""
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(col.cast(pa.string()), "")))
        coded = pc.dictionary_encode(parts.flatten())
        trimmed = pc.replace_substring_regex(coded.dictionary, _MARKS, "")
        h = string_hashes(trimmed)[np.asarray(coded.indices)]
        ends = np.asarray(parts.offsets).astype(np.int64)
        ends = ends - ends[0]
        keep = h != 0
        if not keep.all():
            ends = np.concatenate(([0], np.cumsum(keep)))[ends]
            h = h[keep]
        return h, ends


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return mix64(out)


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about so many bytes of text, or one row."""
    for b in batches:
        col = b.column(text)
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
        start, total = 0, 0
        for i, n in enumerate(size):
            if i > start and total + n > chars:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        if b.num_rows > start:
            yield b.slice(start)
