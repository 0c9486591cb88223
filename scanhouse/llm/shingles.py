"""Word shingles of Arrow batches of texts, as 64-bit fingerprints, without a Python loop per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_BASE = np.uint64(0x9E6C63D0676A9A9D)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; NULL is an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data if data is not None else b"", dtype=np.uint8), offsets


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the rows and the number of words in each row.

    A word is a maximal run without ASCII white space; its hash is a polynomial over its bytes,
    taken from running sums over the whole piece.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = data[lo:hi]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = (offsets[1:-1] - lo).astype(np.int64)  # rows meet without white space between them
    first[edges[edges < len(raw)]] = inside[edges[edges < len(raw)]]
    before = edges[edges > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), dtype=np.uint64)
    total = sums[ends] - np.where(starts > 0, sums[np.maximum(starts, 1) - 1], np.uint64(0))
    hashes = mix(total * _powers(_INVERSE, len(raw))[starts])
    counts = np.diff(np.searchsorted(starts, offsets - lo))
    return hashes, counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each row, end to end, and the set sizes.

    A row of fewer than ``words`` words, but one at least, has its whole sequence as one shingle.
    """
    hashes, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    sets = []
    run = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for i in range(words):
        run = run * _STEP + hashes[i : i + len(run)]
    run = mix(run + np.uint64(words))
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        start = end - n
        if n >= words:
            s = np.sort(run[start : end - words + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            whole = np.zeros(1, np.uint64)
            for h in hashes[start:end]:
                whole = whole * _STEP + h
            sets.append(mix(whole + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def set_digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def batch_sets(batch: pa.RecordBatch, words: int, text: str = "text"):
    """``(first row, sets end to end, set sizes, digests)`` for each piece of a batch."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    for lo, hi in pieces(offsets):
        grams, sizes = shingle_sets(data, offsets[lo : hi + 1], words)
        parts = np.split(grams, np.cumsum(sizes)[:-1])
        yield lo, grams, sizes, [set_digest(p) for p in parts]
