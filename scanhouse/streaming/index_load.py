"""X1 (documents): continuous load of new API-doc files into a vector index.

New JSON-Lines doc files in ``docs_dir`` are picked up once (the checkpoint tracks
seen files); each micro-batch is embedded and becomes a batch of the index, named by the
stream's checkpoint and the batch number and replaced if it is replayed, so no document is
there twice. ``sources.docs.read_index(index_path)`` reads these and all other batches.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scanhouse.operators.retrieval import DEFAULT_DIM
from scanhouse.schemas import API_DOC_DDL
from scanhouse.sources.docs import build_index, shape_api_docs, write_batch


def start_index_load(
    spark: SparkSession,
    docs_dir: str,
    index_path: str,
    checkpoint_dir: str,
    dim: int = DEFAULT_DIM,
    available_now: bool = True,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
    **embed_kw,
) -> StreamingQuery:
    """Start the load. ``max_files_per_trigger`` bounds what one batch takes on of a backlog."""
    reader = spark.readStream.schema(API_DOC_DDL)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    docs = reader.json(docs_dir)
    stream = hashlib.md5(checkpoint_dir.rstrip("/").encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(build_index(shape_api_docs(batch), dim=dim, **embed_kw), index_path, f"s{stream}-{batch_id}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
