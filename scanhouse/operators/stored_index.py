"""R2, S6, S7: a vector index that is stored by cells and searched without moving its rows.

``build_stored_index`` fits pivots (for each vector length) on a bounded sample and writes every row to the folder of its
nearest pivot's cell; pivots, radii and sizes are stored beside them. ``search_stored`` reads the cells that a
chunk of queries visits, by partition pruning, and compares them where they are read: only hits are
shuffled. First come the nearest cells that hold k rows, then only those that the triangle
inequality leaves, so the result is exact. ``add_to_stored_index`` puts new rows in the cells
that are there, and cuts a cell that has outgrown its size anew, reading that one only.

Every write is one commit (``sources.commits``): a search sees whole loads, and a load that
dies leaves nothing. A cell that was cut is left out from then on, and goes when ``rebuild`` or
``commits.sweep`` removes its batch.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanhouse.functions.vectors import DISTANCE_DECIMALS, matrix
from scanhouse.operators.retrieval import (
    FIT_BYTES,
    FIT_ROWS,
    Cells,
    _assigned,
    _compare,
    _numbers,
    _usable,
    bounds_of,
    cells_visited,
    chunk_of,
    fit_cells,
    nearest_pivot,
    sample_of,
)
from scanhouse.schemas import ddl_columns
from scanhouse.session import delete_folder, ensure_checkpoint_dir, scratch_dir, shuffles_dropped, write_scratch
from scanhouse.sources.commits import CommitConflict, batch_folder, commit, entries, live, read_batches

#: Rows that a cell is fitted to; one with over SPLIT times as many is cut anew.
CELL_ROWS, SPLIT = 4096, 2
#: Rows of one file of a cell, at most about.
FILE_ROWS = 100_000
#: Bytes of query vectors that are searched (and broadcast) at once.
QUERY_BYTES = 16 << 20

CELLS_DDL = "dim INT, cell INT, pivot ARRAY<DOUBLE>, radius DOUBLE, n BIGINT, tried BIGINT, gone BOOLEAN"


def stored_cells(spark: SparkSession, root: str, log: list[dict] | None = None) -> dict[int, Cells]:
    """The live cells by vector length: a row per cell comes to the driver."""
    batches = live(entries(spark, root) if log is None else log)
    rows = read_batches(spark, root, "cells", CELLS_DDL, batches).groupBy("dim", "cell").agg(
        F.max("pivot").alias("pivot"), F.max("radius").alias("radius"), F.sum("n").alias("n"), F.max("tried").alias("tried"), F.max("gone").alias("gone")
    )
    by_dim: dict[int, list] = {}
    for r in rows.where("not gone").orderBy("dim", "cell").collect():
        by_dim.setdefault(r["dim"], []).append(r)
    return {dim: Cells(held) for dim, held in by_dim.items()}


def _next_cell(spark: SparkSession, root: str, batches: list[str]) -> int:
    last = read_batches(spark, root, "cells", CELLS_DDL, batches).agg(F.max("cell")).first()[0]
    return 0 if last is None else last + 1


def _write_rows(placed: DataFrame, root: str, batch: str) -> list:
    """Write rows with ``dim, cell, far`` to the folders of their cells: ``(dim, cell, radius, n)`` of each.

    A cell goes to as many tasks as it has files, by the hash of the row, so no task gets a hot cell.
    """
    ensure_checkpoint_dir(placed.sparkSession)
    placed = placed.checkpoint()
    sizes = placed.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    files = placed.sparkSession.createDataFrame([(r["dim"], r["cell"], math.ceil(r["n"] / FILE_ROWS)) for r in sizes], "dim int, cell int, _files int")
    dealt = placed.join(F.broadcast(files), ["dim", "cell"]).withColumn("_file", F.pmod(F.xxhash64("doc_id", "vector"), F.col("_files")))
    dealt = dealt.repartition("dim", "cell", "_file").drop("_file", "_files", "far")
    dealt.write.partitionBy("dim", "cell").mode("overwrite").parquet(batch_folder(root, "rows", batch))
    return sizes


def _write_cells(spark: SparkSession, rows: list[tuple], root: str, batch: str) -> None:
    spark.createDataFrame(rows, CELLS_DDL).coalesce(1).write.mode("overwrite").parquet(batch_folder(root, "cells", batch))


def _placed(rows: DataFrame, dim: int, pivots: np.ndarray, names: np.ndarray) -> DataFrame:
    carry = [c for c in rows.columns if c != "vector"]
    keyed = rows.select(F.monotonically_increasing_id().alias("_row"), F.col("vector").cast("array<double>").alias("_v"), "vector", *carry)
    return _assigned(keyed, pivots, names).drop("_row", "_v").withColumn("dim", F.lit(dim))


def _first_cells(rows: DataFrame, dim: int, n: int, at: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray]:
    vectors = rows.select(F.col("vector").cast("array<double>").alias("v"))
    pivots = fit_cells(sample_of(vectors, "v", dim, n) if n > cell_rows else np.zeros((0, dim)), math.ceil(n / cell_rows))
    return pivots, at + np.arange(len(pivots))


def add_to_stored_index(rows: DataFrame, root: str, cell_rows: int = CELL_ROWS, replace: bool = False) -> str:
    """Add ``rows(doc_id, vector, ...)`` as one commit; the batch's name. The first call builds the index.

    Rows go to the nearest cell that is there; a vector length that is new gets cells of its own. Cells that
    have outgrown ``SPLIT * cell_rows`` are then cut anew. Vectors that are NULL, empty or
    hold NULL or non-finite numbers are left out, as a search leaves them out. ``replace``: these rows
    take the place of all that were there, at once. All adds have the same columns.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    rows = rows.where(_usable(F.col("vector").cast("array<double>"))).checkpoint()
    counts = {r["n"]: r["count"] for r in rows.groupBy(F.size("vector").alias("n")).count().collect()}  # a row per length
    batch = f"b{uuid.uuid4().hex}"
    while True:
        log = entries(spark, root)
        before = live(log)
        cells = {} if replace else stored_cells(spark, root, log)
        at, parts, pivot_of = _next_cell(spark, root, before), [], {}
        for dim, n in sorted(counts.items()):
            own = rows.where(F.size("vector") == dim)
            if dim in cells:
                pivots, names = cells[dim].pivots, cells[dim].ids
            else:
                pivots, names = _first_cells(own, dim, n, at, cell_rows)
                at += len(names)
                pivot_of |= {int(c): p.tolist() for c, p in zip(names, pivots, strict=True)}
            parts.append(_placed(own, dim, pivots, names))
        if not parts:  # nothing to add
            if replace and before:
                commit(spark, root, len(log) + 1, [], before)
            return batch
        sizes = _write_rows(reduce(DataFrame.unionByName, parts), root, batch)
        _write_cells(spark, [(r["dim"], r["cell"], pivot_of.get(r["cell"]), r["radius"], r["n"], 0, False) for r in sizes], root, batch)
        try:
            commit(spark, root, len(log) + 1, [batch], before if replace else [])
            break
        except CommitConflict:
            continue  # the cells may be others now
    split_cells(spark, root, cell_rows)
    return batch


def build_stored_index(rows: DataFrame, root: str, cell_rows: int = CELL_ROWS) -> str:
    """A new index of ``rows``, in place of any that was there: readers see the old one or the new one."""
    return add_to_stored_index(rows, root, cell_rows, replace=True)


def rows_ddl(spark: SparkSession, root: str, batches: list[str]) -> str:
    stored = spark.read.parquet(batch_folder(root, "rows", batches[0])).drop("dim", "cell")
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields) + ", dim int, cell int"


def read_cells(spark: SparkSession, root: str, dim: int, cells: list[int], batches: list[str]) -> DataFrame:
    """The rows of some cells: nothing else is listed or read."""
    rows = read_batches(spark, root, "rows", rows_ddl(spark, root, batches), batches)
    return rows.where((F.col("dim") == dim) & F.col("cell").isin([int(c) for c in cells]))


def _fits(own: DataFrame, dim: int, sizes: dict[int, int], cell_rows: int) -> dict[int, np.ndarray]:
    """New pivots for each cell of ``sizes`` (its rows), fitted by tasks on a bounded sample of the cell."""
    most = min(FIT_ROWS, FIT_BYTES // (8 * dim))
    wanted = [(c, min(1.0, most / n), math.ceil(n / cell_rows)) for c, n in sizes.items()]
    shares = own.sparkSession.createDataFrame(wanted, "cell int, share double, parts int")
    sample = own.select("cell", _numbers(own, "vector").alias("v")).join(F.broadcast(shares), "cell").where(F.rand(11) < F.col("share"))

    def fit(rows: pa.Table) -> pa.Table:
        pivots = fit_cells(matrix(rows.column("v"), dim), rows.column("parts")[0].as_py())
        return pa.table({"cell": pa.array([rows.column("cell")[0].as_py()] * len(pivots), pa.int32()), "pivot": pa.array(pivots.tolist(), pa.list_(pa.float64()))})

    found = sample.groupBy("cell").applyInArrow(fit, "cell int, pivot array<double>").toArrow()  # a row per new cell
    of, pivots = found.column("cell").to_numpy(), matrix(found.column("pivot"), dim)
    return {int(c): pivots[of == c] for c in np.unique(of)}


def _cut(own: DataFrame, dim: int, new: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows of cells that are cut, with their ``cell`` among the new ones (pivots and names by old cell) and ``far``."""
    carry = [c for c in own.columns if c not in ("dim", "cell")]
    rows = own.select("cell", _numbers(own, "vector").alias("_v"), *carry)
    schema = T.StructType([*rows.select(*carry).schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(0).to_numpy()
            for old in np.unique(cells).tolist():
                part = batch.filter(pa.array(cells == old))
                at, far = nearest_pivot(matrix(part.column(1), dim), new[old][0])
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(new[old][1][at].astype(np.int32)), pa.array(far)], names=[*carry, "cell", "far"])

    return rows.mapInArrow(kernel, schema).withColumn("dim", F.lit(dim))


def split_cells(spark: SparkSession, root: str, cell_rows: int = CELL_ROWS) -> str | None:
    """Cut every cell that has more than ``SPLIT * cell_rows`` rows into new ones, as one commit.

    One whose vectors are all equal stays; one that was cut in vain (most vectors equal) is tried
    again when it has grown by half.
    """
    while True:
        log = entries(spark, root)
        batches, batch = live(log), f"x{uuid.uuid4().hex}"
        at, parts, known, rows = _next_cell(spark, root, batches), [], {}, []
        for dim, cells in stored_cells(spark, root, log).items():
            big = (cells.n > SPLIT * cell_rows) & (cells.radius > 0) & (cells.n > 1.5 * cells.tried)
            if not big.any():
                continue
            sizes = dict(zip(cells.ids[big].tolist(), cells.n[big].tolist(), strict=True))
            own, new = read_cells(spark, root, dim, list(sizes), batches), {}
            fitted = _fits(own, dim, sizes, cell_rows)
            for cell, n in sizes.items():
                pivots = fitted.get(cell, np.zeros((1, dim)))
                names = at + np.arange(len(pivots))
                at += len(names)
                known |= {int(c): (p.tolist(), n) for c, p in zip(names, pivots, strict=True)}
                new[cell] = (pivots, names)
                rows.append((int(dim), cell, None, 0.0, 0, 0, True))
            parts.append(_cut(own, dim, new))
        if not parts:
            return None
        sizes = _write_rows(reduce(DataFrame.unionByName, parts), root, batch)
        rows += [(r["dim"], r["cell"], known[r["cell"]][0], r["radius"], r["n"], known[r["cell"]][1] if r["n"] > SPLIT * cell_rows else 0, False) for r in sizes]
        _write_cells(spark, rows, root, batch)
        try:
            commit(spark, root, len(log) + 1, [batch])
            return batch
        except CommitConflict:
            continue


# ---------------------------------------------------------------- search


def _search_chunk(
    spark: SparkSession, root: str, batches: list[str], cells: Cells, dim: int, queries: np.ndarray, ids: np.ndarray, k: int, carry: list[str], path: str
) -> None:
    """Add a chunk's hits, ranked, to a scratch folder: nothing of the chunk stays on the driver."""
    by_query = Window.partitionBy("q").orderBy("raw", "doc_id")
    sent: list = []

    def round_(bound: np.ndarray | None) -> DataFrame | None:
        visited = cells_visited(cells, queries, k, bound)
        if not visited:
            return None
        return _compare(read_cells(spark, root, dim, list(visited), batches), visited, queries, dim, k, carry, ids, bound, sent)

    first = scratch_dir(spark, "search-first")
    hits = write_scratch(round_(None), first)
    kth = hits.withColumn("_r", F.row_number().over(by_query)).where(F.col("_r") == k).select("q", "raw")
    further = round_(bounds_of(ids, kth.toArrow()))  # a row per query of the chunk
    hits = hits if further is None else hits.unionByName(further)
    with shuffles_dropped(spark):
        hits.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).write.mode("append").parquet(path)
    delete_folder(spark, first)
    for shared in sent:
        shared.destroy()


def search_stored(
    queries: DataFrame,
    root: str,
    k: int = 1,
    query_id: str = "query_id",
    query_vec: str = "vector",
    doc_cols: list[str] | None = None,
) -> DataFrame:
    """``query_id, rank, doc_id, distance[, doc_cols...]``: what ``similarity_search`` gives (without
    ``keep_unmatched``), from a stored index of which only the cells that queries visit are read.

    For queries by the batch: their vectors go to the tasks in chunks of ``QUERY_BYTES`` (through the
    driver, one chunk at a time), and each chunk reads the cells it visits. A table of queries as large as
    the index is a join: take ``similarity_search``. An index without a commit has no hits.
    """
    spark, carry, k = queries.sparkSession, list(doc_cols or []), int(k)
    ensure_checkpoint_dir(spark)
    log = entries(spark, root)
    batches, cells = live(log), stored_cells(spark, root, log)
    v = _numbers(queries, query_vec)
    q = queries.select(F.monotonically_increasing_id().alias("q"), v.alias("qv"), F.col(query_id).alias("query_id")).where(_usable(F.col("qv"))).checkpoint()
    counts = {r["n"]: r["count"] for r in q.groupBy(F.size("qv").alias("n")).count().collect()}  # a row per length
    path, found = scratch_dir(spark, "search-hits"), False
    for dim in sorted(set(counts) & set(cells)):
        chunks = math.ceil(counts[dim] * 8 * dim / QUERY_BYTES)
        for c in range(chunks):
            held = chunk_of(q.where(F.size("qv") == dim).select("q", "qv"), c, chunks).toArrow()
            if held.num_rows:
                _search_chunk(spark, root, batches, cells[dim], dim, matrix(held.column("qv"), dim), held.column("q").to_numpy(), k, carry, path)
                found = True
    if not found:
        ddl = rows_ddl(spark, root, batches) if batches else "doc_id bigint"
        empty = spark.createDataFrame([], ddl)
        empty = empty.select("doc_id", *[c if c in ddl_columns(ddl.replace("`", "")) else F.lit(None).alias(c) for c in carry])
        return empty.select(F.lit(None).cast(queries.schema[query_id].dataType).alias("query_id"), F.lit(1).alias("rank"), "doc_id", F.lit(0.0).alias("distance"), *carry)
    hits = spark.read.parquet(path)
    return q.select("q", "query_id").join(hits, "q").select("query_id", "rank", "doc_id", F.round("raw", DISTANCE_DECIMALS).alias("distance"), *carry)
