"""Words of whole texts, hashed without a Python loop over words.

A batch of texts is one byte buffer. A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. Its *identity* is 128 bits and
its length: the bytes themselves up to 16 of them, a keyed digest of longer ones. Hashes mix the identity, so that different
short words differ by construction and long ones by a cryptographic hash; none has the algebra of a polynomial. ``codes``
compares bytes. Null texts have no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa

#: Texts are taken together up to so many bytes; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20

_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
_HIGH = np.array([0xD1B54A32D192ED03, 0xA0761D6478BD642F], dtype=np.uint64)
_SIZE = np.array([0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def separators(extra: bytes = b"") -> np.ndarray:
    sep = np.zeros(256, dtype=bool)
    sep[[0x20, *range(0x09, 0x0E), *extra]] = True
    return sep


WHITE = separators()


def _firsts(code: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    out[code[::-1]] = np.arange(len(code))[::-1]
    return out


@dataclass
class Words:
    """Words of a batch: ``first[d]:first[d + 1]`` are those of document d."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    known: dict = field(default_factory=dict, repr=False)

    def word(self, i: int, lower: bool = False) -> bytes:
        own = self.buffer[self.start[i] : self.end[i]]
        return (_LOWER[own] if lower else own).tobytes()

    def identity(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two 64-bit numbers and the length of each word; ``lower``: of its bytes with A-Z lower-cased."""
        if lower not in self.known:
            data = np.zeros(len(self.buffer) + 16, dtype=np.uint8)
            data[: len(self.buffer)] = _LOWER[self.buffer] if lower else self.buffer
            at = np.ndarray(len(self.buffer) + 9, dtype="<u8", buffer=data, strides=(1,))
            size = self.end - self.start
            low = at[self.start] & _MASK[np.minimum(size, 8)]
            high = at[np.minimum(self.start + 8, len(self.buffer))] & _MASK[np.clip(size - 8, 0, 8)]
            long = np.flatnonzero(size > 16)
            if len(long):
                whole = memoryview(data)
                sums = b"".join(hashlib.blake2b(whole[a:b], digest_size=16, key=b"word").digest() for a, b in zip(self.start[long].tolist(), self.end[long].tolist()))
                low[long], high[long] = np.frombuffer(sums, dtype="<u8").reshape(-1, 2).T
            self.known[lower] = low, high, size
        return self.known[lower]

    def hashes(self, family: int = 0, lower: bool = False) -> np.ndarray:
        """64-bit hashes; two families are independent, so both together are a fingerprint of 128 bits."""
        low, high, size = self.identity(lower)
        return mix(mix(low ^ _SALT[family]) + high * _HIGH[family] + size.astype(np.uint64) * _SIZE[family])

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each word, equal exactly where the words' bytes are equal, and the first word of each number."""
        code, unique = pd.factorize(self.hashes())
        first = _firsts(code, len(unique))
        like = first[code]
        low, high, size = self.identity()
        same = (size == size[like]) & (low == low[like]) & (high == high[like])
        for i in np.flatnonzero(same & (size > 16) & (like != np.arange(len(code)))).tolist():
            same[i] = self.word(i) == self.word(like[i])
        if not same.all():  # two words with one hash: tell all apart by their bytes
            code, unique = pd.factorize(np.array([self.word(i) for i in range(len(code))], dtype=object))
            first = _firsts(code, len(unique))
        return code, first

    def documents(self) -> np.ndarray:
        """The batch's document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(buffer: np.ndarray, offsets: np.ndarray, sep: np.ndarray = WHITE) -> Words:
    """buffer: bytes of all documents; document d is offsets[d]:offsets[d + 1]."""
    inside = ~sep[buffer]
    n = len(buffer)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(buffer, none, none, np.zeros(len(offsets), dtype=np.int64))
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(opens)
    return Words(buffer, start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    low, high = int(offsets[0]), int(offsets[-1])
    buffer = np.frombuffer(data, dtype=np.uint8)[low:high] if data is not None and high > low else np.zeros(0, dtype=np.uint8)
    return buffer, offsets - low


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in parts of at most ``limit`` bytes of text (or one row), with its text buffer."""
    if batch.num_rows == 0:
        return
    buffer, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield batch.slice(low, high - low), buffer[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def ngram_hashes(word_hash: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words from each place on (of the whole batch, so some run over a document's end)."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    odd = np.random.default_rng(31 * n + salt).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out += word_hash[k : k + m] * odd[k]
    return mix(out)


def within(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the places 0..total-n start n words of one document."""
    m = max(0, total - n + 1)
    ok = np.ones(total + 1, dtype=bool)
    for k in range(1, n):
        at = first[1:] - k
        ok[at[at >= 0]] = False
    # a document shorter than n - 1 words may reach back over an earlier one: that place is closed already
    return ok[:m]
