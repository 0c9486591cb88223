"""Helpers shared by the corpus operators: tables, shared scratch, id joins, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanhouse.session import scratch_dir, shuffles_dropped

#: A side is broadcast only after its rows were counted and lie below this (24 bytes a row).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends here, and a
    lost executor costs only the tasks that read its part again."""
    path = scratch_dir(df.sparkSession, purpose)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialise`` once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (counted), else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


#: Bits for each key of a filter, and bytes of one at most (with more keys it lets more rows pass).
FILTER_BITS, FILTER_BYTES, FILTER_TASKS = 16, 32 << 20, 16


def key_filter(keys: DataFrame, column: str, n: int):
    """A condition, by a column, that holds for all ``n`` keys and for few other values: a Bloom filter made
    by tasks. It keeps rows without a partner out of a join's shuffle; the join itself decides."""
    bits = 1 << min(int(FILTER_BYTES * 8).bit_length() - 1, max(10, (n * FILTER_BITS - 1).bit_length()))

    def places(h: np.ndarray) -> np.ndarray:
        h = h.view(np.uint64)
        return np.concatenate([(h >> np.uint64(s)) & np.uint64(bits - 1) for s in (0, 20, 36)]).astype(np.int64)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[places(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["bits"])

    hashed = keys.select(F.xxhash64(column).alias("h")).coalesce(FILTER_TASKS).mapInArrow(fill, "bits binary")
    whole = np.zeros(bits // 8, np.uint8)
    for row in hashed.toLocalIterator():
        whole |= np.frombuffer(row["bits"], np.uint8)
    held = keys.sparkSession.sparkContext.broadcast(whole)

    @F.arrow_udf(T.BooleanType())
    def passes(h: pa.Array) -> pa.Array:
        at = places(h.to_numpy(zero_copy_only=False))
        hit = (held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return pa.array(hit.reshape(3, -1).all(axis=0))

    return lambda c: passes(F.xxhash64(c))


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]):
    """Join condition over pairs of columns in which NULL equals NULL."""
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


#: A group with over 1/HOT_SHARE of all rows is joined by broadcast; fewer than HOT_SHARE exist.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, by: list[str], size: str, n_rows: int) -> DataFrame:
    """Inner join of rows with one row per group, whose ``size`` column counts its rows.

    Groups with more than 1/HOT_SHARE of the rows are broadcast, so that no task gets a hot
    group; no group of the rest, joined by a shuffle, can be hot.
    """
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(n_rows))
    cold = groups.where(F.col(size) * HOT_SHARE <= F.lit(n_rows))
    rest = rows.join(F.broadcast(hot.select(by)), by, "left_anti")
    return rows.join(F.broadcast(hot), by).unionByName(rest.join(cold, by))


# --- connected components -------------------------------------------------------------

FOREST_CHUNK = 1 << 20


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edge list and the smallest node that each reaches in it."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:  # hook larger roots on smaller ones, then jump pointers
        lx, ly = label[x], label[y]
        lo, hi = np.minimum(lx, ly), np.maximum(lx, ly)
        if (lo == hi).all():
            return nodes, nodes[label]
        np.minimum.at(label, hi, lo)
        while not np.array_equal(up := label[label], label):
            label = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each chunk by one edge from every node to its smallest node."""

    def shrink(parts):
        t = pa.Table.from_batches(parts)
        a, b = (t.column(i).to_numpy() for i in (0, 1))
        nodes, root = _roots(a, b)
        m = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[m]), pa.array(root[m])], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= FOREST_CHUNK:
            yield shrink(held)
            held, n = [], 0
    if held:
        yield shrink(held)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph of long node ids: ``edges(u, v)`` to ``(node, component)``.

    ``component`` is the smallest node reachable; nodes without an edge are not listed. Tasks
    first shrink their own edges to a forest, then large-star and small-star steps alternate
    until the edges are stars. Each step is two map-side-combined minimums and joins (a hot node's
    join is one that adaptive execution may split); edges are written to the shared folder
    after each round, so nothing depends on an executor.
    """
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    edges = edges.toDF("u", "v").where("u <> v")
    edges = materialise(edges.mapInArrow(_forest, schema).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialise(small.union(down.select("u", "m")).distinct(), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
