"""Operator 11: periodic runs of words by recompression, without suffix arrays.

A piece of a batch (whole texts, end to end, parted by symbols that occur once) is rewritten by
turns: block compression makes one symbol of a maximal repetition of a symbol, pair compression
one of each pair whose first symbol is on the left side of a random split of the alphabet and
whose second is on the right. Equal stretches are rewritten equally but for their ends, so the
layers are a run-length grammar in which the longest common extension (LCE) of two places needs a
few comparisons a layer: upward while both are at the start of a symbol, then downward at the
first difference. The same layers read backwards give extensions to the left.

Candidates lie on a harmonic grid: a run of period p and exponent 4 repeats at least 3p words at
distance p, so one of the places 0, 3p, 6p, ... is among them. That is n/3 * ln(n) pairs of
places for n words; those whose words are equal are extended exactly in both directions.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scanhouse.llm.common import table
from scanhouse.llm.shingles import pieces, text_buffers

#: A run has at least this many words, and at least EXPONENT periods.
LEAST_WORDS, EXPONENT = 6, 4
#: Candidates that are looked at in one go.
GRID_BLOCK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

RUNS = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(ids, words, counts)``: each word's number among the distinct ``words`` (an object array
    of bytes), all rows end to end, and the number of words in each row."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = data[lo:hi]
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1] - lo
    edges = edges[edges < len(raw)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    at = np.concatenate([np.cumsum(inside)[starts] - 1, [inside.sum()]]).astype(np.int64)
    buffers = [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw[inside]))]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    words = np.array(coded.dictionary.to_pylist() or [b""], dtype=object)
    counts = np.diff(np.searchsorted(starts, offsets - lo))
    return coded.indices.to_numpy().astype(np.int64), words, counts


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random bit of each symbol: which side of the split it is on."""
    x = (x.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(63)).astype(bool)


class Grammar:
    """Layers of the recompressed sequence.

    ``sym[l]`` are the symbols of layer l, ``up[l]`` the places of their parents in layer l + 1,
    ``down[l]`` the place of the first child in layer l of each symbol of layer l + 1, and one past
    the last, ``blocks[l]`` whether layer l + 1 comes of block compression. The sequence begins and ends with a bar; bars stay symbols of their own. It ends at
    the layer in which nothing but bars has a neighbour that is no bar.
    """

    def __init__(self, seq: np.ndarray, bars: np.ndarray, n_symbols: int):
        self.sym, self.up, self.down, self.blocks = [seq], [], [], []
        bar, names, turn = bars, n_symbols, 0
        while True:
            plain = ~bar
            if not (plain[1:] & plain[:-1]).any():
                return
            s = self.sym[-1]
            first = np.ones(len(s), dtype=bool)
            if turn % 2 == 0:  # blocks
                first[1:] = s[1:] != s[:-1]
                starts = np.flatnonzero(first)
                sizes = np.diff(np.append(starts, len(s)))
                joined = sizes > 1
                second = sizes
            else:  # pairs
                left = _mixed(s, turn) & plain
                right = ~_mixed(s, turn) & plain
                first[1:] = ~(left[:-1] & right[1:])
                starts = np.flatnonzero(first)
                joined = np.diff(np.append(starts, len(s))) == 2
                second = s[np.minimum(starts + 1, len(s) - 1)]
            turn += 1
            if not joined.any():
                continue
            self.blocks.append(turn % 2 == 1)
            new = s[starts]
            code, _ = pd.factorize(new[joined] * np.int64(max(names, int(second.max()) + 1)) + second[joined])
            new[joined] = names + code
            names += int(code.max()) + 1
            self.up.append((np.cumsum(first) - 1).astype(np.int32))
            self.down.append(np.append(starts, len(s)).astype(np.int32))
            self.sym.append(new)
            bar = bar[starts]

    def backwards(self) -> Grammar:
        """The grammar of the sequence read from its end."""
        other = object.__new__(Grammar)
        other.blocks = self.blocks
        other.sym = [s[::-1] for s in self.sym]
        other.up = [np.int32(len(s) - 1) - u[::-1] for u, s in zip(self.up, self.sym[1:], strict=True)]
        other.down = [np.int32(len(s)) - d[::-1] for d, s in zip(self.down, self.sym, strict=False)]
        return other

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that are equal from places i and j on (i != j; a bar comes before the end).

        Upward: in each layer both places step over the equal rest of a block or pair, after which
        they are at starts of symbols of the next layer, or they have met a difference. Downward
        from there: equal symbols are stepped over, the first unequal ones opened.
        """
        u, v = i.astype(np.int64), j.astype(np.int64)
        level = np.full(len(u), len(self.up), dtype=np.int64)  # where the first difference is met
        live = np.arange(len(u))
        for k, (s, up, down) in enumerate(zip(self.sym, self.up, self.down, strict=False)):
            a, b = u[live], v[live]
            pa_, pb = up[a], up[b]
            rest_a, rest_b = down[pa_ + 1] - a, down[pb + 1] - b
            at_start = (down[pa_] == a) & (down[pb] == b)
            equal = s[a] == s[b]
            step = np.where(at_start | ~equal, 0, np.minimum(rest_a, rest_b))
            meets = ~at_start & (~equal | (rest_a != rest_b))
            # a pair's second symbol against a lone one: both rests are 1; unequal rests end here
            a, b = a + step, b + step
            level[live[meets]] = k
            u[live[meets]], v[live[meets]] = a[meets], b[meets]
            on = ~meets
            live, a, b = live[on], a[on], b[on]
            u[live], v[live] = up[a], up[b]
        self._descend(u, v, level)
        return u - i

    def _descend(self, u: np.ndarray, v: np.ndarray, level: np.ndarray) -> None:
        top = len(self.up)
        for k in range(top, -1, -1):
            s = self.sym[k]
            live = np.flatnonzero(level >= k)
            while len(live):  # step over what is equal in this layer
                a, b = u[live], v[live]
                equal = s[a] == s[b]
                live, a, b = live[equal], a[equal], b[equal]
                if not len(live):
                    break
                if k < top and self.blocks[k]:
                    up, down = self.up[k], self.down[k]
                    step = np.minimum(down[up[a] + 1] - a, down[up[b] + 1] - b)
                    u[live], v[live] = a + step, b + step
                else:
                    u[live], v[live] = a + 1, b + 1
            if k:
                live = np.flatnonzero(level >= k)
                down = self.down[k - 1]
                u[live], v[live] = down[u[live]], down[v[live]]


def grid(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, place, period)`` of the harmonic grid of every row, about GRID_BLOCK at a time."""
    rows = np.flatnonzero(counts >= LEAST_WORDS)
    most = np.maximum(counts[rows] // EXPONENT, 1)  # periods 1 .. n / EXPONENT
    ends = np.cumsum(most)
    total = int(ends[-1]) if len(ends) else 0
    for lo in range(0, total, GRID_BLOCK // 8):
        flat = np.arange(lo, min(lo + GRID_BLOCK // 8, total))
        k = np.searchsorted(ends, flat, side="right")
        period = flat - (ends[k] - most[k]) + 1
        row = rows[k]
        n = counts[row] - period  # places that have a partner
        cells = -(-n // (3 * period))
        at, filled = 0, np.cumsum(cells)
        while at < len(flat):  # a period has at most n / 3 places; take as many as fit
            done = filled[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(filled, done + GRID_BLOCK, side="right")))
            c = cells[at:to]
            nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            p = np.repeat(period[at:to], c)
            yield np.repeat(row[at:to], c), nth * 3 * p, p
            at = to


def find_runs(ids: np.ndarray, counts: np.ndarray, n_words: int) -> np.ndarray:
    """All runs of the rows: an array of (row, start, length, period), in that order, sorted."""
    rows = len(counts)
    base = np.cumsum(counts) - counts + np.arange(rows) + 1  # a bar before every row and at the end
    seq = np.empty(len(ids) + rows + 1, dtype=np.int64)
    bars = np.ones(len(seq), dtype=bool)
    bars[np.repeat(base - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = False
    seq[~bars] = ids
    seq[bars] = n_words + np.arange(rows + 1)
    forth = back = None
    found, last = [], len(seq) - 1
    for row, place, period in grid(counts):
        i = base[row] + place
        hit = seq[i] == seq[i + period]
        if not hit.any():
            continue
        row, period, i = row[hit], period[hit], i[hit]
        if forth is None:
            forth = Grammar(seq, bars, n_words + rows + 1)
            back = forth.backwards()
        j = i + period
        right = forth.lce(i, j)
        left = back.lce(last - i, last - j) - 1  # the place itself counts in both
        start, length = i - left - base[row], left + right + period
        keep = length >= np.maximum(LEAST_WORDS, EXPONENT * period)
        found.append(np.stack([row[keep], start[keep], length[keep], period[keep]], axis=1))
    if not found:
        return np.zeros((0, 4), dtype=np.int64)
    runs = np.unique(np.concatenate(found), axis=0)
    # a stretch of smallest period q is met with multiples of q too: the first is the smallest
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
    return runs[new]


def planted(ids: np.ndarray, counts: np.ndarray, keys: list) -> np.ndarray:
    """The word numbers after the stated repetition of some rows: with ``h = crc32(key)`` and
    ``g = h // 10``, a row of n > 0 words whose h is a multiple of 10 repeats its words from
    ``a = g % n`` on with period ``1 + (n - a) // (3 + g % 8)``. A NULL key changes nothing."""
    ids, ends = ids.copy(), np.cumsum(counts)
    for key, n, end in zip(keys, counts.tolist(), ends.tolist(), strict=True):
        if key is None or not n:
            continue
        h = zlib.crc32(str(key).encode())
        if h % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        tail = ids[end - n + a : end]
        tail[:] = np.resize(tail[:p].copy(), n - a)
    return ids


def _summary(runs: np.ndarray) -> tuple:
    """``(n_runs, start, length, period, exponent_milli, sha256)`` of one row's sorted runs."""
    if not len(runs):
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest()
    ordered = runs[np.lexsort((runs[:, 3], runs[:, 1]))].tolist()
    digest = hashlib.sha256()
    for r in ordered:
        digest.update(b"%d,%d,%d\n" % (r[1], r[2], r[3]))
    _, s, n, p = min(ordered, key=lambda r: (-Fraction(r[2], r[3]), r[1], r[3]))
    return len(ordered), s, n, p, 1000 * n // p, digest.hexdigest()


def run_kernel(plant: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in pieces(offsets):
                ids, words, counts = word_ids(data, offsets[lo : hi + 1])
                if plant:
                    ids = planted(ids, counts, batch.column(0).slice(lo, hi - lo).to_pylist())
                runs = find_runs(ids, counts, len(words))
                first = np.searchsorted(runs[:, 0], np.arange(hi - lo + 1))
                begin = np.cumsum(counts) - counts
                drop = np.zeros(len(ids) + 1, dtype=np.int64)  # +1 where a dropped stretch begins, -1 after it
                np.add.at(drop, begin[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
                np.add.at(drop, begin[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
                stays = np.cumsum(drop[:-1]) == 0
                out = []
                for r in range(hi - lo):
                    own = slice(int(begin[r]), int(begin[r] + counts[r]))
                    kept = words[ids[own][stays[own]]].tolist()
                    out.append((*_summary(runs[first[r] : first[r + 1]]), hashlib.sha256(b" ".join(kept)).hexdigest()))
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.string()] * 2, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *cols],
                    names=["doc_id", *(c.split()[0] for c in RUNS.split(", "))],
                )

    return rows


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """The periodic runs of words of each row of ``docs(doc_id, text, ...)``.

    A run is a stretch of consecutive words with smallest period q, of at least ``max(6, 4q)``
    words, that no neighbouring word extends. Columns: doc_id, n_runs; start, length, period and
    exponent_milli of the run of greatest length / period (ties: smallest start, then period;
    all NULL without a run); runs_sha256 of the lines ``start,length,period``;
    collapsed_sha256 of the words that no run holds after its first q words, joined by one space.

    A NULL or blank text has no words and no runs; repeated rows and NULL ids are
    treated like others (``plant``, the stated repetition of some rows, leaves NULL ids as they are);
    other columns are not read. No shuffle; a text is one task's, with about 120 bytes a word.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run_kernel(plant), f"doc_id {id_type}, {RUNS}")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
