"""The words of many texts at once, each with a 64-bit hash, in numpy on the bytes of an Arrow column.

Words lie between ASCII white space; A-Z count as lower case. A word's hash mixes its length and its bytes, eight at a
time, for all words together; the few words over LONGEST bytes are hashed by xxhash, one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    data: np.ndarray        # bytes of all texts, A-Z in lower case, and eight zeros
    counts: np.ndarray      # words of each text
    start: np.ndarray       # of each word in the bytes
    end: np.ndarray
    hashes: np.ndarray

    def texts(self, at: np.ndarray) -> pa.Array:
        """The words at these places."""
        size = self.end[at] - self.start[at]
        offsets = np.concatenate([[0], np.cumsum(size)])
        places = np.arange(offsets[-1]) + np.repeat(self.start[at] - offsets[:-1], size)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[places])).cast(pa.string())


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from ``start`` to ``end`` in bytes that are followed by eight more."""
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))       # the eight bytes from every byte on
    size = end - start
    found = mix((eight[start] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more, done = np.flatnonzero((size > 8) & (size <= LONGEST)), 8
    while more.size:
        left = size[more] - done
        found[more] = mix((found[more] ^ (eight[start[more] + done] & _MASKS[np.minimum(left, 8)])) * np.uint64(0xD1342543DE82EF95))
        more, done = more[left > 8], done + 8
    for i in np.flatnonzero(size > LONGEST).tolist():
        import xxhash

        found[i] = xxhash.xxh64_intdigest(data[start[i]:end[i]].tobytes())
    return found


def hash_word(word: bytes) -> int:
    """The hash of one word, which is in lower case."""
    return int(_hashes(np.frombuffer(word + bytes(8), np.uint8), np.array([0]), np.array([len(word)]))[0])


def words_in(texts: pa.Array) -> Words:
    """All words of the texts, in order; null is a text without words."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.zeros(1, np.int64)
    if len(texts):
        offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    low, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    offsets = offsets - low
    data = np.zeros(n + 8, dtype=np.uint8)
    if n:
        data[:n] = np.frombuffer(texts.buffers()[2], np.uint8)[low:low + n]
    data |= ((data - np.uint8(ord("A"))) < 26).view(np.uint8) << 5
    inside = (data != 0x20) & ((data - np.uint8(9)) >= 5)
    inside = inside[:n]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]               # a text's first byte is no part of the word before it
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, np.diff(np.searchsorted(start, offsets)), start, end, _hashes(data, start, end))
