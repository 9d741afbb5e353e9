"""Splitting byte buffers into words and hashing the words, without a loop over words.

Texts come as UTF-8 in Arrow binary arrays. Every separator that the operators
use is an ASCII character, so bytes can be classified one by one. A word's hash
is a polynomial of its bytes over the integers modulo 2**64, taken from running
sums, and then mixed; it depends on the bytes alone.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 19
CHUNK = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
SHINGLE_CODE = _rng.integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def release() -> None:
    """Gives freed memory back to the system, as far as the platform can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(call: Callable) -> Callable:
    """Lets a function over batches release its memory at the end, as workers stay alive between tasks."""

    @functools.wraps(call)
    def wrapped(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from call(self, batches)
        release()

    return wrapped


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all bits."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_cache: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _cache.get("p")
    if have is None or len(have[0]) < n:
        have = _cache["p"] = _powers(max(n, 1 << 16))
    return have


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``buf[start:end]``; spans ascend and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        base = int(starts[k])
        j = max(k + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        top = int(ends[j - 1])
        part = BYTE_CODE[buf[base:top]]
        pw, inv = powers(len(part) + 1)
        run = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * pw[: len(part)], out=run[1:])
        s, e = starts[k:j] - base, ends[k:j] - base
        out[k:j] = (run[e] - run[s]) * inv[s] + (e - s).astype(np.uint64)
        k = j
    return mix(out)


@dataclass
class Words:
    """Words of consecutive texts. ``first[d]:first[d + 1]`` are those of text d."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.starts, self.ends)


def find_words(buf: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    """``buf`` holds the texts one after the other, ``offsets`` their bounds from 0."""
    if len(buf):
        inside = word_bytes[buf]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(buf)]
        begins[heads] = inside[heads]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        stops[tails] = inside[tails]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    else:
        starts = ends = np.empty(0, dtype=np.int64)
    return Words(buf, offsets, starts, ends, np.searchsorted(starts, offsets))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow binary array; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``limit`` bytes of text each, or one longer text."""
    if not batch.num_rows:
        return
    buf, bounds = flat(batch.column(batch.schema.get_field_index(column)))
    k, n = 0, len(bounds) - 1
    while k < n:
        j = max(k + 1, int(np.searchsorted(bounds, bounds[k] + limit, side="right")) - 1)
        yield batch.slice(k, j - k), buf[bounds[k] : bounds[j]], bounds[k : j + 1] - bounds[k]
        k = j


def shingle_hashes(w: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their bounds by text.

    A text of fewer words, but not none, has its whole sequence as the only one.
    """
    n_words = np.diff(first)
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], counts)
    length = np.repeat(np.minimum(n_words, size), counts)
    total = length.astype(np.uint64)
    for i in range(size):
        has = length > i
        total += np.where(has, w[np.where(has, at + i, 0)] * SHINGLE_CODE[i], 0) if len(at) else 0
    return mix(total, size), bounds
