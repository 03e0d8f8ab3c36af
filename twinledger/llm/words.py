"""Hashes of words, of runs of words and of sets of them, over many texts at once."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PIECE = 1 << 22
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def released() -> None:
    """Gives back what a task leaves with the allocators: Spark keeps its workers, and their memory, for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:  # glibc keeps freed arrays below other ones
        trim(0)



def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all of them, one to one."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD[0]))


@functools.lru_cache(2)
def _powers(size: int, odd: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2**64, and those of its inverse."""
    out = []
    for base in (odd, pow(odd, -1, 1 << 64)):
        factors = np.full(size, base, U64)
        factors[0] = 1
        out.append(np.multiply.accumulate(factors))
    return out[0], out[1]


def powers(size: int, odd: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(size).bit_length()), odd)


def run_hashes(values: np.ndarray, length: int, odd: int) -> np.ndarray:
    """The hash of each run of ``length`` consecutive values."""
    if len(values) < length:
        return np.zeros(0, U64)
    up, down = powers(len(values), odd)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(values * up[:len(values)], dtype=U64)])
    return mix((sums[length:] - sums[:-length]) * down[:len(values) - length + 1])


def folded(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER)


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _pieces(buffer: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about ``_PIECE`` bytes that end behind a blank; the buffer ends with one."""
    start = 0
    while start < len(buffer):
        end = min(start + _PIECE, len(buffer))
        while end < len(buffer) and not _BLANK[buffer[end - 1]]:
            ahead = np.flatnonzero(_BLANK[buffer[end:end + 4096]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + 4096, len(buffer))
        yield start, end
        start = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and where each text's words begin (one more at the end)."""
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    whole = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    hashes, begins = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for start, end in _pieces(whole):
        buffer = whole[start:end]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[buffer], [True]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        up, down = powers(len(buffer) + 1, _ODD[1])
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[buffer] * up[:len(buffer)], dtype=U64)])
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64)))
        begins.append(starts + start)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), bounds)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``size`` consecutive words; of all its words, if fewer."""
    hashes, at = word_hashes(texts)
    runs = run_hashes(hashes, size, _ODD[2])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a:b - size + 1]))
        elif b > a:  # another space than that of full shingles, and one for each number of words
            out.append(mix(run_hashes(hashes[a:b], b - a, _ODD[0]) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def blocks(texts: list[bytes], most: int, rows: int) -> Iterator[slice]:
    """Slices of at most ``rows`` consecutive texts and ``most`` bytes, or of one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > most or i - start == rows):
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))
