"""Operator 8: near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Equal vectors are one class. Centroids are fitted on a bounded sample; every vector gets a home
cell, and is a guest of other cells near whose border it lies. Within a cell, home rows and guests
are cut into blocks, and cosines of a block of home rows with each other block are matrix products
in double precision. Pairs that reach the threshold link; those found in two cells count in one.
Links give components, of which the smallest id is kept.

Two linked unit vectors are at most r = sqrt(2 - 2t) apart, so for a pair with homes a and b one
of them misses the other's cell by at most r/2 * |c_a - c_b|. With ``slack`` 1, as in the
query, guests go that far and no link is lost. There are as many cells as cost least on the sample:
vectors without clusters would be guests nearly everywhere, and are compared in a few cells or one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanhouse.functions.vectors import slices
from scanhouse.llm.common import _roots, connected_components, discard, join_groups, materialise, table
from scanhouse.session import scratch_dir, shuffles_dropped

#: Vectors that the centroids are fitted on, at most (about), and their bytes; all vectors are
#: assigned and compared.
FIT_ROWS, FIT_BYTES, FIT_ROUNDS = 20_000, 64 << 20, 12
CELL_ROWS, MAX_CELLS = 1024, 4096
SLACK = 1.0
#: Moving a row to a pair of blocks costs about as much as so many cosines.
MOVED = 1000
#: Rows of a block at most, and bytes of their vectors; a task holds two blocks, some times over.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
#: Rows that a round moves, if there are fewer.
ROUND_ROWS = 200_000
#: Products of unit vectors so near to the threshold are taken again, from the vectors as given.
NEAR = 1e-9
#: Rows of a block whose cosines with a whole block are held at once.
STRIP = 512


def valid_rows(batch_column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, vector)`` of rows that are not NULL or empty, nor hold NULL or non-finite parts, nor are zero."""
    for i, v in enumerate(batch_column):
        if v.is_valid and len(v.values) and v.values.null_count == 0:
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
            if np.isfinite(x).all() and np.abs(x).max() > 0:
                yield i, x


def digest_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, digest and vector (doubles) of every row; NULL digest and vector if not valid. The vector
    is scaled by a power of two, which changes no digit, so that no square over- or underflows."""
    for batch in batches:
        n = batch.num_rows
        digests, vectors = [None] * n, [None] * n
        for i, x in valid_rows(batch.column(1)):
            digests[i] = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
            vectors[i] = np.ldexp(x, -np.frexp(np.abs(x).max())[1]).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "digest", "vector"])


def matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(len(vectors), -1)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def units(vectors: list[bytes]) -> np.ndarray:
    x = matrix(vectors)
    return x / norms(x)[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Unit centroids of ``k`` cells; a cell that loses all rows keeps its centroid."""
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([np.argmax(part @ c.T, axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return c


def cells_of(x: np.ndarray, c: np.ndarray, threshold: float, slack: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, home, row x cell)`` of stretches of unit vectors: the nearest centroid, and the cells that a
    row is in. Products with all centroids, and reaches between homes and cells, are of bounded size."""
    for lo, hi in slices(len(c), len(x)):
        s = x[lo:hi] @ c.T
        h = s.argmax(axis=1)
        homes, at = np.unique(h, return_inverse=True)
        # how much smaller a guest's product with a cell's centroid may be than that with its home's
        reach = slack * np.sqrt(2 - 2 * threshold) / 2 * np.sqrt(np.maximum(0, 2 - 2 * c[homes] @ c.T)) + 1e-9
        yield lo, h, s >= s[np.arange(len(s)), h][:, None] - reach[at]


def cost(x: np.ndarray, c: np.ndarray, n: int, threshold: float, slack: float) -> float:
    """Cosines, and moved rows in terms of them, of ``n`` vectors like those of the sample ``x``."""
    homes, cells = np.zeros(len(c)), np.zeros(len(c))
    for _, h, inside in cells_of(x, c, threshold, slack):
        homes += np.bincount(h, minlength=len(c))
        cells += inside.sum(axis=0)
    homes, guests = homes * n / len(x), (cells - homes) * n / len(x)
    blocks, others = np.ceil(homes / BLOCK_ROWS), np.ceil(guests / BLOCK_ROWS)
    return float((homes * (homes / 2 + guests) + MOVED * (homes * (blocks + others) + guests * blocks)).sum())


def fit_cells(classes: DataFrame, n: int, threshold: float, slack: float) -> dict[int, np.ndarray]:
    """Centroids by dimension, from a bounded sample; dimensions not in it have a single cell."""
    width = classes.agg(F.max(F.length("vector"))).first()[0] or 1
    share = min(1.0, min(FIT_ROWS, FIT_BYTES // width) / max(n, 1))
    sample = classes.select("class_id", "vector")
    sample = sample.where(F.pmod(F.xxhash64("class_id"), F.lit(1 << 32)) < int(share * (1 << 32))) if share < 1 else sample
    by_dim: dict[int, list[bytes]] = {}
    for r in sample.orderBy("class_id").select("vector").collect():
        by_dim.setdefault(len(r[0]) // 8, []).append(bytes(r[0]))
    out = {}
    for dim, held in by_dim.items():
        x, rows = units(held), n * len(held) / sum(map(len, by_dim.values()))
        k = min(MAX_CELLS, max(1, round(rows / CELL_ROWS)), len(held))
        fits = [spherical_kmeans(x, k >> i) for i in range(0, k.bit_length() - 1, 2)] + [spherical_kmeans(x, 1)]
        out[dim] = min(fits, key=lambda c: cost(x, c, rows, threshold, slack))
    return out


def cell_kernel(centroids: dict[int, np.ndarray], threshold: float, slack: float):
    """A row for each cell of each vector: dim, cell, class_id, home, cells, n, vector. ``cells`` are, in its home
    cell, those of the vector that come before it; nobody asks a guest for them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            dims = np.array([len(v) // 8 for v in vectors], dtype=np.int64)
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                for lo, h, inside in cells_of(units([vectors[i] for i in of]), centroids.get(dim, np.ones((1, dim))), threshold, slack):
                    # a vector may be a guest of all cells, each time with all its parts
                    for a, b in slices(inside.sum(axis=1) * dim):
                        at, cell = np.nonzero(inside[a:b])
                        home = h[a:b][at]
                        earlier = inside[a:b] & (np.arange(inside.shape[1]) < h[a:b, None])
                        ends = np.concatenate([[0], np.cumsum(np.where(cell == home, earlier.sum(axis=1)[at], 0))])
                        cells = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.nonzero(earlier)[1].astype(np.int32)))
                        taken = batch.take(pa.array(of[lo + a + at]))
                        cols = [pa.array(np.full(len(at), dim, np.int32)), pa.array(cell.astype(np.int32)), taken.column(0), pa.array(home.astype(np.int32)), cells, taken.column(2), taken.column(1)]
                        yield pa.RecordBatch.from_arrays(cols, names=["dim", "cell", "class_id", "home", "cells", "n", "vector"])

    return rows


def tile_pairs(cell: int, rows: list[tuple], same: bool, threshold: float):
    """Links of one pair of blocks: ``(class ids, weighted link counts, roots)``.

    ``rows``: (side, class_id, home, cells before it, n, vector); pairs are those across sides, or, if ``same``,
    those within the one block. A pair counts here if one of the two is at home in the cell and,
    where both homes hold it, this is the smaller. Products of unit vectors are rounded, so pairs
    within NEAR of the threshold are decided by the product over the norms of the vectors given.
    """
    rows.sort(key=lambda r: (r[0], r[1]))
    left = len(rows) if same else sum(r[0] == 0 for r in rows)
    ids = np.array([r[1] for r in rows], dtype=np.int64)
    home = np.array([r[2] for r in rows])
    n = np.array([r[4] for r in rows], dtype=np.int64)
    given = matrix([r[5] for r in rows])
    norm = norms(given)
    x = given / norm[:, None]
    # products in single precision tell which pairs are far below the threshold
    single, rounding = x.astype(np.float32), 1e-4 + x.shape[1] * 2.0**-22
    homes = np.unique(home)
    member = np.array([np.isin(homes, r[3]) for r in rows])  # row x home: a row of this cell has it among its cells
    home_at = np.searchsorted(homes, home)
    counts = np.zeros(len(rows), np.int64)
    label = np.arange(len(rows))
    first = 0 if same else left
    for lo in range(0, left, STRIP):
        hi = min(lo + STRIP, left)
        rough = single[lo:hi] @ single[first:].T
        i, j = np.nonzero(rough >= np.float32(threshold - rounding))
        if len(i) <= rough.size // 64:
            parts = np.array_split(np.arange(len(i)), max(1, len(i) // 4096))
            cosine = np.concatenate([np.einsum("ij,ij->i", x[lo + i[p]], x[first + j[p]]) for p in parts])
        else:  # a large group
            cosine = x[lo:hi] @ x[first:].T
            i, j = np.nonzero(cosine >= threshold - NEAR)
            cosine = cosine[i, j]
        keep = cosine >= threshold - NEAR
        cosine, i, j = cosine[keep], i[keep] + lo, j[keep] + first
        near = np.flatnonzero(cosine < threshold + NEAR)
        for part in np.array_split(near, max(1, len(near) // 4096)):
            a, b = i[part], j[part]
            cosine[part] = (given[a] * given[b]).sum(axis=1) / (norm[a] * norm[b])
        sure = cosine >= threshold
        i, j = i[sure], j[sure]
        ok = (i < j) & ((home[i] == cell) | (home[j] == cell))
        i, j = i[ok], j[ok]
        other = np.where(home[i] == cell, j, i)
        mine = np.where(home[i] == cell, i, j)
        twice = (home[other] < cell) & member[mine, home_at[other]]
        i, j = i[~twice], j[~twice]
        counts += np.bincount(i, weights=n[j], minlength=len(rows)).astype(np.int64)
        counts += np.bincount(j, weights=n[i], minlength=len(rows)).astype(np.int64)
        nodes, root = _roots(np.concatenate([i, np.arange(len(rows))]), np.concatenate([j, label]))
        label[nodes] = root
    return ids, counts, ids[label]


def tile_kernel(threshold: float):
    """Rows sorted by (dim, cell, lo, hi) to ``(class_id, links, root)``."""

    def close(key, held):
        ids, counts, roots = tile_pairs(key[1], held, key[2] == key[3], threshold)
        some = (counts > 0) | (ids != roots)
        return pa.RecordBatch.from_arrays([pa.array(a[some]) for a in (ids, counts, roots)], names=["class_id", "links", "root"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for part in (batch.slice(lo, STRIP) for lo in range(0, batch.num_rows, STRIP)):
                for r in part.to_pylist():
                    k = (r["dim"], r["cell"], r["lo"], r["hi"])
                    if k != key:
                        if key is not None:
                            yield close(key, held)
                        key, held = k, []
                    held.append((int(r["block"] != r["lo"]), r["class_id"], r["home"], r["cells"], r["n"], r["vector"]))
        if key is not None:
            yield close(key, held)

    return rows


def tile_links(classes: DataFrame, n_classes: int, centroids: dict[int, np.ndarray], threshold: float, slack: float) -> DataFrame:
    """``class_id, links, root`` of every tile of ``classes(class_id, n, vector)``, in rounds.

    A row goes to each block that its own meets, and these grow with a cell. So what is moved grows with the square
    of a cell's rows; a round moves about as many rows as there are, takes the tiles whose blocks add up to
    its number, and leaves nothing but links.
    """
    spark = classes.sparkSession
    if all(len(c) == 1 for c in centroids.values()):  # everybody is at home
        one = {"dim": (F.length("vector") / 8).cast("int"), "cell": F.lit(0), "home": F.lit(0), "cells": F.array().cast("array<int>")}
        placed = classes.select("class_id", "n", "vector").withColumns(one)
        n_rows = n_classes
    else:
        schema = "dim int, cell int, class_id bigint, home int, cells array<int>, n bigint, vector binary"
        placed = materialise(classes.select("class_id", "vector", "n").mapInArrow(cell_kernel(centroids, threshold, slack), schema), "cells")
        n_rows = placed.count()
    # blocks of home rows come first: they meet each other and all blocks of guests, which don't meet among themselves
    at_home = F.col("home") == F.col("cell")
    counts = placed.groupBy("dim", "cell").agg(F.count(F.when(at_home, 1)).alias("at_home"), F.count(F.when(~at_home, 1)).alias("away"))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))))
    n_blocks = [F.ceil(F.col(c) / most).cast("int").alias(a) for c, a in (("at_home", "homes"), ("away", "guests"))]
    sizes = materialise(counts.select("*", *n_blocks).where("homes > 0"), "cell-sizes")
    moved = sizes.agg(F.sum(F.expr("at_home * (homes + guests) + away * homes"))).first()[0] or 0
    rounds = max(1, -(-moved // max(n_rows, ROUND_ROWS)))
    sizes = sizes.select("dim", "cell", "homes", "guests")
    blocks = placed.join(F.broadcast(sizes) if len(centroids) <= 16 else sizes, ["dim", "cell"])
    block = F.when(at_home, F.pmod(F.xxhash64("class_id"), F.col("homes"))).otherwise(F.col("homes") + F.pmod(F.xxhash64("class_id"), F.col("guests")))
    blocks = blocks.withColumn("block", block.cast("int")).withColumn("met", F.col("homes") + F.when(at_home, F.col("guests")).otherwise(0))
    by, path, schema = ["dim", "cell", "lo", "hi"], scratch_dir(spark, "vector-links"), "class_id bigint, links bigint, root bigint"
    for r in range(rounds):
        first = F.pmod(F.lit(r) - F.col("block"), F.lit(rounds))
        others = F.when(first < F.col("met"), F.sequence(first, F.col("met") - 1, F.lit(rounds)))
        tiles = blocks.withColumn("other", F.explode(others))
        tiles = tiles.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "met", "homes", "guests")
        links = tiles.repartition(*by).sortWithinPartitions(*by).mapInArrow(tile_kernel(threshold), schema)
        with shuffles_dropped(spark):
            links.write.mode("append").parquet(path)
    for done in (placed, sizes):
        discard(done)
    return spark.read.schema(schema).parquet(path)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, slack: float = SLACK) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, ...)``: vec_id, n_links, component_id, kept.

    Vectors of the same length link when their cosine is at least ``threshold``; ``n_links`` counts
    other rows, equal vectors included. ``component_id`` is the smallest vec_id reached by links.
    NULL, empty or zero vectors and those with NULL or non-finite parts link with nothing
    and stay. NULL ids are never the smallest. No rows give none; other columns are not read.
    """
    vectors = vectors.select("vec_id", "embedding")
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    spark = vectors.sparkSession
    digests = vectors.mapInArrow(digest_kernel, f"vec_id {id_type}, digest binary, vector binary")
    with shuffles_dropped(spark):
        rows = materialise(digests.select("vec_id", "digest"), "vectors")
        usable = rows.where("digest is not null")
        classes = digests.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
        given = materialise(classes.withColumn("class_id", F.monotonically_increasing_id()), "vector-classes")
    classes = materialise(given.drop("vector"), "vector-digests")
    n_classes = classes.count()
    centroids = fit_cells(given, n_classes, threshold, slack)
    links = tile_links(given, n_classes, centroids, threshold, slack)
    discard(given)

    groups = connected_components(links.select("class_id", "root")).toDF("class_id", "component")
    counted = links.groupBy("class_id").agg(F.sum("links").alias("links"))
    full = classes.join(counted, "class_id", "left").join(groups, "class_id", "left")
    full = full.withColumn("component", F.coalesce("component", "class_id"))
    lowest = full.groupBy("component").agg(F.min("first_id").alias("component_id"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    resolved = materialise(full.join(lowest, "component").select("digest", "n", n_links, "component_id"), "vector-groups")
    out = join_groups(usable.select("vec_id", "digest"), resolved, ["digest"], "n", rows.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.expr("vec_id <=> component_id"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(m.low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(m.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) n ON n.x = e.vec_id
LEFT JOIN (SELECT x, min(y) AS low FROM r GROUP BY x) m ON m.x = e.vec_id
"""
