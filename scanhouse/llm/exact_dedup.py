"""Operator 10: exact duplicates through an extendible-hash index on shared files.

Every text is hashed to a 64-bit key and a 256-bit digest, and its entry goes into an extendible-hash
index: a directory over the key's leading bits whose overfull buckets split, round by round, by
doubling the directory. Entries are routed to their bucket, and buckets are dealt to owner tasks by the
range of keys that they cover. An owner finds the equal entries in its buckets: one slot for
each (key, digest), and slots of the same key in a chain. The index is written to the shared
folder. Where a slot stands for several rows, their bytes are compared; texts that differ in
spite of equal digests get places of their own in the chain.

Only DataFrame functions run here. Copies are combined by SALTS before they are routed, so no bucket
is hot; texts move only for rows whose slot is shared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanhouse.llm.common import BROADCAST_ROWS, discard, join_groups, materialise, null_safe, small_enough, table

WHITE_SPACE = r"[\x20\x09-\x0D]+"
BUCKET_SLOTS = 4096
#: Entries of one text reach its owner as at most so many partial ones.
SALTS = 8


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def bucket_prefix(key: Column, depth: int) -> Column:
    """The ``depth`` leading bits of the key, as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory_rounds(slots: DataFrame, n_slots: int, bucket_slots: int = BUCKET_SLOTS) -> DataFrame:
    """Route every row of ``slots(key, ...)`` to a bucket of at most ``bucket_slots`` distinct keys.

    Starts at the depth that an even spread needs and doubles the directory while some bucket
    is overfull; only those buckets' slots take part in the next round. Adds ``depth`` and
    ``bucket`` (the leading bits) to the slots. Keys that are equal share a bucket for ever: they
    are one key here and a chain inside it.
    """
    depth = max(0, (max(n_slots, 1) // bucket_slots).bit_length() - 1)
    pending, placed = slots, None
    while True:
        here = pending.withColumn("depth", F.lit(depth)).withColumn("bucket", bucket_prefix(F.col("key"), depth))
        keys = here.groupBy("bucket", "key").count().groupBy("bucket").agg(F.count("*").alias("n_keys"))
        overfull = materialise(keys.where(F.col("n_keys") > bucket_slots).select("bucket"), "directory")
        n_over = overfull.count()
        side = F.broadcast(overfull) if n_over <= BROADCAST_ROWS else overfull
        fits = here.join(side, "bucket", "left_anti") if n_over else here
        placed = fits if placed is None else placed.unionByName(fits)
        if not n_over:
            return placed
        pending = here.join(side, "bucket", "left_semi").select(*slots.columns)
        depth += 1


def build_index(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, bucket_slots: int = BUCKET_SLOTS
) -> tuple[DataFrame, DataFrame]:
    """``(entries, index)`` of ``docs(doc_id, text)``, both on shared files.

    ``entries``: one row per input row (doc_id, row_id, key, digest). ``index``: one row per slot
    (key, digest, n, keep: the first row by doc_id, NULL ids last; depth, bucket; place in the chain
    of its key), each bucket in one file, in key order.
    """
    text = normalised(F.col("text"))
    hashed = docs.select("doc_id", text.alias("t")).select(
        "doc_id", F.xxhash64(digest(F.col("t"))).alias("key"), digest(F.col("t")).alias("digest")
    )
    entries = materialise(hashed.withColumn("row_id", F.monotonically_increasing_id()), "entries")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))
    salt = F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).alias("salt")
    partial = entries.groupBy("key", "digest", salt).agg(F.count("*").alias("n"), first.alias("keep")).drop("salt")
    partial = materialise(partial, "partial-entries")
    n_keys = partial.agg(F.approx_count_distinct("key")).first()[0]
    routed = directory_rounds(partial, n_keys, bucket_slots)
    # a bucket covers the keys from `low` on: owners hold ranges of them, and need no further shuffle
    low = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(bucket, 64 - depth)"))
    owned = routed.withColumn("low", low).repartitionByRange("low")
    slots = owned.groupBy("low", "depth", "bucket", "key", "digest").agg(F.sum("n").alias("n"), F.min("keep").alias("keep"))
    place = F.row_number().over(Window.partitionBy("low", "depth", "bucket", "key").orderBy("digest")) - 1
    index = slots.withColumn("place", place).drop("low").sortWithinPartitions("key", "digest")
    index = materialise(index, "index")
    discard(partial)
    return entries, index


def compare_bytes(docs: DataFrame, entries: DataFrame, index: DataFrame, digest=sha256) -> DataFrame | None:
    """Rows whose text differs from another one of the same slot: (doc_id, key, digest, chain).

    ``chain`` numbers the texts of a slot in byte order, from 0. None if there are no such slots.
    """
    shared = index.where("n > 1").select("key", "digest", "n")
    n_rows = index.agg(F.sum("n")).first()[0] or 0
    ids = join_groups(entries, shared, ["key", "digest"], "n", n_rows).select("doc_id").distinct()
    ids = materialise(ids, "shared-ids")
    ids = small_enough(ids)
    rows = docs.select("doc_id", "text").join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    rows = rows.select("doc_id", normalised(F.col("text")).alias("t"))
    rows = rows.withColumn("digest", digest(F.col("t"))).withColumn("key", F.xxhash64("digest"))
    texts = rows.groupBy("key", "digest", "t").agg(F.count("*").alias("n"))
    clash = texts.groupBy("key", "digest").agg(F.count("*").alias("k")).where("k > 1").select("key", "digest")
    clash = materialise(clash, "clashes")
    if clash.isEmpty():
        return None
    order = Window.partitionBy("key", "digest").orderBy("t")
    chain = texts.join(clash, ["key", "digest"], "left_semi").select("key", "digest", "t", (F.row_number().over(order) - 1).alias("chain"))
    out = rows.join(chain, ["key", "digest", "t"]).groupBy("doc_id", "key", "digest").agg(F.min("chain").alias("chain"))
    return materialise(out, "chains")


def exact_duplicates(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, bucket_slots: int = BUCKET_SLOTS
) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, keep_id, group_size, kept, digest.

    Texts are equal if they are after ``normalised``. Of equal texts the row with the smallest
    doc_id stays; NULL ids come last, and of rows that repeat an id one stays. A NULL text is
    an empty one; empty texts form a group like any other. An empty table gives no rows. Other
    columns of ``docs`` are not read. ``digest`` is a parameter so that tests can force clashes.
    """
    docs = docs.select("doc_id", "text")
    entries, index = build_index(docs, digest, bucket_slots)
    chains = compare_bytes(docs, entries, index, digest)
    if chains is None:
        groups = index.select("key", "digest", F.lit(0).alias("chain"), "n", "keep")
        members = entries.withColumn("chain", F.lit(0))
    else:
        pairs = [(c, c) for c in ("doc_id", "key", "digest")]
        members = entries.join(chains, null_safe(entries, chains, pairs), "left").select(
            *[entries[c] for c in entries.columns], F.coalesce(chains["chain"], F.lit(0)).alias("chain")
        )
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))
        groups = members.groupBy("key", "digest", "chain").agg(F.count("*").alias("n"), first.alias("keep"))
        groups = materialise(groups, "groups")
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    by = ["key", "digest", "chain"]
    return join_groups(members, groups, by, "n", n_rows).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"),
        "digest",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    Dropped rows are found by (doc_id, digest), since an id may stand on several texts; of rows
    that repeat both, one stays, whichever of them comes first.
    """
    found = materialise(exact_duplicates(docs).select("doc_id", "digest", "kept"), "decisions")
    by_pair = found.groupBy("doc_id", "digest").agg(F.max("kept").alias("some"), F.count("*").alias("n"))
    by_pair = materialise(by_pair.where("not some or n > 1"), "dropped")
    gone, again = by_pair.where("not some"), by_pair.where("some")
    mark = f"_digest_{uuid.uuid4().hex}"  # no column of the documents can have this name
    hashed = docs.withColumn(mark, sha256(normalised(F.col("text"))))

    def against(rows: DataFrame, how: str) -> DataFrame:
        side = small_enough(rows.select("doc_id", "digest"), BROADCAST_ROWS // 2)
        return hashed.join(side, null_safe(hashed, side, [("doc_id", "doc_id"), (mark, "digest")]), how)

    if again.isEmpty():
        return against(gone, "left_anti").drop(mark)
    repeated = against(again, "left_semi").dropDuplicates(["doc_id", mark])
    return against(by_pair, "left_anti").unionByName(repeated).drop(mark)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
