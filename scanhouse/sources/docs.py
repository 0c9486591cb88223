"""S5-S7: API-doc catalogue, vector index save/load, appending documents to an index.

An index is a folder of batches, ``<path>/rows/batch=<name>/``, whoever writes it: a build, an
append or a batch of the streaming load. Those that its commit log counts are read
(``sources.commits``), so an overwrite shows the old documents until it shows the new ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanhouse.operators.retrieval import DEFAULT_DIM, embed
from scanhouse.schemas import API_DOC_DDL, INDEX_DDL, ddl_columns
from scanhouse.session import delete_folder
from scanhouse.sources.commits import CommitConflict, batch_folder, commit, entries, live, read_batches

ROWS = "rows"


class IndexNotInitialised(RuntimeError):
    """The vector index folder does not exist (yet)."""


def read_api_docs(spark: SparkSession, path: str | list[str], fmt: str = "json") -> DataFrame:
    """``doc_id, content, api, required_fields`` rows from JSON Lines or parquet (file or folder)."""
    reader = spark.read.schema(API_DOC_DDL)
    df = reader.json(path) if fmt == "json" else reader.format(fmt).load(path)
    return shape_api_docs(df)


def shape_api_docs(df: DataFrame) -> DataFrame:
    """Fill the optional fields: ``required_fields`` never NULL; a missing ``doc_id`` is a
    stable hash of (content, api), so the same document gets the same id on every load."""
    return df.select(
        F.coalesce(F.col("doc_id"), F.xxhash64("content", "api")).alias("doc_id"),
        "content",
        "api",
        F.coalesce(F.col("required_fields"), F.array().cast("array<string>")).alias("required_fields"),
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", dim: int = DEFAULT_DIM, **embed_kw) -> DataFrame:
    """Embed ``content`` and shape rows as the index schema."""
    req = F.col("required_fields") if "required_fields" in docs.columns else F.lit(None)
    shaped = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col("content"),
        F.col("api"),
        F.coalesce(req.cast("array<string>"), F.array().cast("array<string>")).alias("required_fields"),
    )
    return embed(shaped, "content", dim=dim, out_col="vector", **embed_kw).select(*ddl_columns(INDEX_DDL))


def write_batch(index: DataFrame, path: str, batch: str, overwrite: bool = False) -> None:
    """Add one batch as one commit. A batch whose name is committed already is left as it is;
    with ``overwrite`` the others that were there no longer count, and their folders go."""
    spark = index.sparkSession
    log = entries(spark, path)
    if any(batch in (e["adds"] or []) for e in log):
        return
    index.select(*ddl_columns(INDEX_DDL)).write.mode("overwrite").parquet(batch_folder(path, ROWS, batch))
    while True:
        before = live(log) if overwrite else []
        try:
            commit(spark, path, len(log) + 1, [batch], before)
            break
        except CommitConflict:
            log = entries(spark, path)
    for old in before:
        delete_folder(spark, batch_folder(path, ROWS, old))


def write_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Add a batch; with ``overwrite`` it replaces all that was there, at once."""
    write_batch(index, path, f"b{uuid.uuid4().hex}", overwrite=mode == "overwrite")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The documents that count now; ``IndexNotInitialised`` before the first commit."""
    batches = live(entries(spark, path))
    if not batches:
        raise IndexNotInitialised(f"vector index not initialised: {path}")
    return read_batches(spark, path, ROWS, INDEX_DDL, batches)


def add_documents(spark: SparkSession, index_path: str, docs: DataFrame, dim: int = DEFAULT_DIM, **embed_kw) -> None:
    """Embed ``docs`` (doc_id, content, api[, required_fields]) and append them to the index."""
    read_index(spark, index_path)  # fails clearly if the index was never built
    write_index(build_index(docs, dim=dim, **embed_kw), index_path, mode="append")
