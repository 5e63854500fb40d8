"""Hashes of words and of their n-grams, for many texts at once in numpy.

A word is a run of bytes other than blank and 0x09 to 0x0D; A-Z count as a-z. Its hash is a
polynomial over random 64-bit values of its bytes, read from one running sum over the buffer,
and mixed. The hashes depend on the seed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

from .common import texts_of

_U = np.uint64
_BASE = 0x5851F42D4C957F2D
#: Bytes of text that are worked on at once, unless one text alone is longer.
RUN_BYTES = 1 << 20

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + mix(np.array([seed + 1], dtype=np.uint64)))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[i] = np.cumprod(x)
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and where each text's words begin (one more entry than texts)."""
    data = [t.encode() for t in texts]
    raw = np.frombuffer(b"\n".join(data).lower() + b"\n", dtype=np.uint8)
    word = _IS_WORD[raw]
    step = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        step = np.concatenate(([0], step))
    starts, ends = step[::2], step[1::2]
    power, inverse = _powers(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_byte_values(seed)[raw] * power[: len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(d) + 1 for d in data], out=begins[1:])
    return hashes, np.searchsorted(starts, begins)


def _gram(h: np.ndarray, k: int, n: int) -> np.ndarray:
    x = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(x)


def sequences(texts: list[str], k: int, seed: int = 0) -> list[np.ndarray]:
    """For each text the hashes of its k-grams of words in order; fewer words than k are one gram, no words none."""
    h, begins = word_hashes(texts, seed)
    grams = _gram(h, k, max(0, len(h) - k + 1))
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        n = b - a
        out.append(grams[a : b - k + 1] if n >= k else _gram(h[a:b], n, 1) if n else grams[:0])
    return out


def sets(texts: list[str], k: int, seed: int = 0) -> list[np.ndarray]:
    """For each text its distinct k-grams' hashes, sorted."""
    return [np.unique(x) for x in sequences(texts, k, seed)]


def identity(tokens: np.ndarray, seed: int) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for a set."""
    x = xxhash.xxh3_128_intdigest(tokens.tobytes(), seed)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return signed(x >> 64), signed(x & ((1 << 64) - 1))


def runs(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in parts of about ``RUN_BYTES`` bytes of text, each with its texts."""
    texts = texts_of(batch, name)
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= RUN_BYTES or i + 1 == len(texts):
            yield batch.slice(at, i + 1 - at), texts[at : i + 1]
            at, size = i + 1, 0
