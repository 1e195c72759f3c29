"""Vectorised word splitting and hashing over Arrow string columns.

Every separator of the word patterns used here is ASCII, so words are found on
UTF-8 bytes. One call handles a whole Arrow batch: no Python string is made for
a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Odd multiplier of the byte polynomial and its inverse modulo 2**64.
P = 0x9E3779B97F4A7C15
P_INV = pow(P, -1, 1 << 64)

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words `[^\x20\x09-\x0D]+`.
NOT_SPACE = _SPACE
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing A-Z.
LOWER_ALNUM = _ALNUM
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

#: Words hashed at once.
STRETCH = 1 << 15

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next batch."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base & (2**64 - 1), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@dataclass
class Words:
    """Words of a batch: byte spans in `data`, and the first word of each text in `first` (length texts + 1)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes (and length)."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):  # some words at a time: the bytes' powers stay small
            to = min(len(out), at + STRETCH)
            a, b = int(self.start[at]), int(self.end[to - 1])
            total = np.zeros(b - a + 1, np.uint64)
            np.multiply(_BYTE[self.data[a:b]], _power(P, b - a), out=total[1:])
            np.cumsum(total, out=total)
            start, end = self.start[at:to] - a, self.end[at:to] - a
            own = (total[end] - total[start]) * _power(P_INV, b - a)[start]
            out[at:to] = mix(own + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))
            at = to
        return out

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit digests of each word: the halves of its XXH3-128. Equal words are digested once."""
        if not len(self.start):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        data, start, _ = self.joined()
        offsets = np.append(start, len(data)).astype(np.int64)
        distinct = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        digest = xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join([digest(w) for w in distinct.dictionary.to_pylist()]), np.uint64).reshape(-1, 2)
        of = distinct.indices.to_numpy()
        return both[of, 0], both[of, 1]

    def joined(self, separator: int = 0x20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all words with one separator after each, and each word's start and end there."""
        size = self.end - self.start
        stop = np.cumsum(size + 1)
        at = stop - size - 1
        out = np.full(int(stop[-1]) if len(stop) else 0, separator, np.uint8)
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.start] += 1
        inside[self.end] -= 1
        kept = np.cumsum(inside[:-1], dtype=np.int8).view(bool) if len(self.data) else np.zeros(0, bool)
        target = np.ones(len(out), bool)
        target[stop - 1] = False
        out[target] = self.data[kept]
        return out, at, stop - 1


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split(texts: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    data, offsets = buffers(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = kind[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | fresh[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | fresh[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, n: int, base: int = 0xA24BAED4963EE407) -> np.ndarray:
    """Hash of each run of n consecutive words (over the whole batch; callers drop runs that cross texts)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = out * U(base) + hashes[j : j + len(out)]
    return mix(out)


def inner_starts(words: Words, n: int) -> np.ndarray:
    """Whether a run of n words that starts at each word ends in the same text."""
    limit = np.repeat(words.first[1:], words.counts())
    return np.arange(len(words.start)) + n <= limit


def batches(rows, column: str, limit: int = 8 << 20):
    """Slices of Arrow batches whose texts hold about `limit` bytes at most (one longer text stands alone)."""
    for batch in rows:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
