"""Numpy helpers that run inside Spark tasks (Arrow batches), never on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DISTANCE_DECIMALS = 6


#: Numbers that a kernel works on at once; its temporary arrays are some times as large.
WORK_CELLS = 1 << 18


def slices(width: np.ndarray | int, n: int | None = None) -> Iterator[tuple[int, int]]:
    """``(from, to)`` of consecutive rows that have ``WORK_CELLS`` numbers or, where one row has more, just
    that row. ``width``: the numbers of each row, or of every one of ``n`` rows."""
    ends = np.cumsum(width) if n is None else np.arange(1, n + 1) * max(1, int(width))
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + WORK_CELLS, side="right")))
        yield lo, hi
        lo = hi


def list_slices(column: pa.ListArray, least: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, row, value)`` of a list column of integers, in stretches of bounded size: the row, counted
    from the stretch's first, and the value of every element. A NULL list has none. ``least``: numbers that a row takes at least."""
    lens = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
    for lo, hi in slices(np.maximum(lens, least)):
        part = column.slice(lo, hi - lo)
        yield lo, hi, np.repeat(np.arange(hi - lo, dtype=np.int64), lens[lo:hi]), np.asarray(part.flatten(), dtype=np.int64)


def term_counts_of(row: np.ndarray, bucket: np.ndarray, n: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts of ``n`` rows at once: ``(row, bucket, tf, weight)``.

    One ``np.unique`` over ``row * dim + bucket`` keys (no per-row Python loop); weight is
    tf over the row's L2 norm, in float64.
    """
    keys, tf = np.unique(row * dim + bucket, return_counts=True)
    r = keys // dim
    norm = np.sqrt(np.bincount(r, weights=(tf * tf).astype(np.float64), minlength=n))
    return r, (keys % dim).astype(np.int32), tf.astype(np.int64), tf / norm[r]


def dense_normalized(column: pa.ListArray, dim: int) -> pa.ListArray:
    """Dense L2-normalised float32 count vectors of a batch of bucket lists (a zero vector stays zero)."""
    out = np.zeros((len(column), dim), dtype=np.float32)
    for lo, hi, row, bucket in list_slices(column, least=dim):
        counts = np.bincount(row * dim + bucket, minlength=(hi - lo) * dim).reshape(hi - lo, dim).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(axis=1))
        out[lo:hi] = np.divide(counts, norm[:, None], out=np.zeros_like(counts), where=norm[:, None] > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim, dtype=np.int32)), pa.array(out.reshape(-1)))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column of ``dim`` numbers a row as a float64 matrix, by one reshape."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def fit_pivots(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """``n`` centres of ``x`` by Lloyd's rounds, from the same start each time."""
    c = x[np.random.default_rng(0).choice(len(x), size=n, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([distances(x[lo:hi], c).argmin(axis=1) for lo, hi in slices(n, len(x))])
        sums, count = np.zeros_like(c), np.bincount(near, minlength=n)
        np.add.at(sums, near, x)
        c[count > 0] = sums[count > 0] / count[count > 0, None]
    return c


def distances(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product: quick, and right up to rounding."""
    return np.maximum(0.0, (q * q).sum(axis=1)[:, None] + (d * d).sum(axis=1)[None, :] - 2.0 * (q @ d.T))


#: Part of the dimensions that every pair is compared in first, and the share of pairs that may be left
#: after it for the rest to be taken pair by pair.
LEADING, SURVIVORS = 8, 1 / 16


def fit_rotation(x: np.ndarray, k: int) -> np.ndarray | None:
    """An orthogonal basis of the sample ``x`` in which leading dimensions tell most of a distance, or None
    if they leave too many pairs of the sample open. Distances are the same in any such basis."""
    if len(x) < 64 or x.shape[1] < 2 * LEADING:
        return None
    centred = x - x.mean(axis=0)
    rotation = np.linalg.eigh(centred.T @ centred)[1][:, ::-1].copy()
    q, d = x[:256], x[-2048:]
    _, _, work = near_pairs(q, d, k, rotation)
    return rotation if work < 0.5 * len(q) * len(d) * x.shape[1] else None


def near_pairs(q: np.ndarray, d: np.ndarray, k: int, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs ``(query, doc)`` among which are each query's k nearest docs, and the multiply-adds spent on pairs.

    The squared distance in the leading dimensions of the rotated vectors never exceeds the whole one. The k
    docs that are nearest in these are compared in full, which bounds the k-th distance; pairs beyond it
    go, and the others take on as many dimensions again, until none are left.
    """
    n, dim = len(q) * len(d), q.shape[1]
    m = max(1, dim // LEADING)
    slack = 1e-9 * ((q * q).sum(axis=1) + (d * d).sum(axis=1).max())
    q, d = q @ rotation, d @ rotation
    part = distances(q[:, :m], d[:, :m])
    kk = min(k, len(d))
    pick = np.argpartition(part, kk - 1, axis=1)[:, :kk]
    rest = d[pick][:, :, m:] - q[:, None, m:]
    bound = (np.take_along_axis(part, pick, axis=1) + (rest * rest).sum(axis=2)).max(axis=1) + slack
    work = n * m + len(q) * kk * (dim - m)
    i, j = np.nonzero(part <= bound[:, None])
    so_far = part[i, j]
    while m < dim and len(i):
        to = min(dim, 2 * m)
        if len(i) > SURVIVORS * n:
            so_far += distances(q[:, m:to], d[:, m:to])[i, j]
            work += n * (to - m)
        else:
            diff = q[i, m:to] - d[j, m:to]
            so_far += np.einsum("ij,ij->i", diff, diff)
            work += len(i) * (to - m)
        m = to
        keep = so_far <= bound[i]
        i, j, so_far = i[keep], j[keep], so_far[keep]
    return i, j, work


def within(qv: np.ndarray, dv: np.ndarray, bound: np.ndarray, k: int, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, doc row, distance)`` of the docs that lie within each query's bound, the nearest ``k`` of them
    at most, ranked by distance and then by doc row."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    norm = (dv * dv).sum(axis=1).max()
    for s in range(0, len(qv), chunk):
        q, most = qv[s : s + chunk], bound[s : s + chunk]
        i, j = np.nonzero(distances(q, dv) <= (most + 1e-9 * ((q * q).sum(axis=1) + norm))[:, None])
        if not len(i):
            continue
        pairs = np.array_split(np.arange(len(i)), max(1, len(i) // 4096))
        # summed as in block_top_k
        dist = np.concatenate([np.sort((q[i[p]] - dv[j[p]]) ** 2, axis=1).sum(axis=1) for p in pairs])
        keep = dist <= most[i]
        i, j, dist = i[keep], j[keep], dist[keep]
        by = np.lexsort((j, dist, i))
        i, j, dist = i[by], j[by], dist[by]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((i[rank < k] + s, j[rank < k], dist[rank < k]))
    i, j, dist = (np.concatenate(c) for c in zip(*out, strict=True))
    return i, j, dist


def block_top_k(
    qv: np.ndarray, dv: np.ndarray, order: np.ndarray, k: int, chunk: int = 64, rotation: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact k nearest docs for each query of one block: squared L2 in float64.

    Returns ``(query row, doc row, distance)`` for ``<= k`` docs per query, ranked by the raw
    distance and then by ``order``. A matrix product picks who can be among the k, within its
    rounding, or, with a ``rotation``, filters do that take on dimension by dimension (``near_pairs``);
    their distances are then summed exactly.
    """
    out_q, out_d, out_dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    kk = min(k, len(dv))
    if kk:
        norm = (dv * dv).sum(axis=1).max()
        for s in range(0, len(qv), chunk):
            q = qv[s : s + chunk]
            if rotation is None:
                near = distances(q, dv)
                bound = np.partition(near, kk - 1, axis=1)[:, kk - 1] + 1e-9 * ((q * q).sum(axis=1) + norm)
                i, j = np.nonzero(near <= bound[:, None])
            else:
                i, j, _ = near_pairs(q, dv, k, rotation)
            diff = q[i] - dv[j]
            # summed in order of size, so that the order of the dimensions leaves no trace in ties
            dist = np.sort(diff * diff, axis=1).sum(axis=1)
            by = np.lexsort((order[j], dist, i))
            i, j, dist = i[by], j[by], dist[by]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            out_q.append(i[rank < kk] + s)
            out_d.append(j[rank < kk])
            out_dist.append(dist[rank < kk])
    return np.concatenate(out_q), np.concatenate(out_d), np.concatenate(out_dist)
