"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanhouse.session import ensure_checkpoint_dir

#: Most rows of a side that is broadcast, once they have been counted.
BROADCAST_ROWS = 200_000


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """``df`` dealt round-robin over ``partitions`` tasks, or as it is if that is None.

    For CPU-heavy row work on a table that is stored in fewer splits than there are cores; it
    moves all rows once, so the caller asks for it by number.
    """
    return df.repartition(int(partitions)) if partitions else df


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A small aggregate, checkpointed and counted: marked for broadcast up to ``rows`` rows,
    left to a shuffled join (whose hot keys adaptive execution splits) beyond."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint()
    return F.broadcast(kept) if kept.count() <= rows else kept
