import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scanhouse.llm import exact_dedup
from scanhouse.llm.exact_dedup import build_index, drop_duplicates, exact_duplicates

from .conftest import EDGE


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = Counter()
    for ids in groups.values():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        kept = Counter({(keep, True): 1})
        for i in ids:
            flag = bool(kept[i, True]) and i == keep
            kept[i, True] -= flag
            out[i, keep, len(ids), flag] += 1
    return out


def first_byte(text):
    """A digest that clashes all the time."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 1))


@pytest.mark.parametrize("digest", [None, first_byte])
def test_equals_brute_force(spark, edge, digest):
    more = [(100 + i, f"text {i % 40}") for i in range(200)]
    docs = edge.select("doc_id", "text", "digest", "key").union(spark.createDataFrame(more, "doc_id bigint, text string").selectExpr("*", "'a'", "'b'"))
    options = {"bucket_slots": 4} | ({"digest": digest} if digest else {})
    rows = exact_duplicates(docs.repartition(5), **options).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == brute(EDGE + more)


def test_buckets_hold_their_keys(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(1000)], "doc_id bigint, text string")
    _, index = build_index(docs, bucket_slots=16)
    sizes = index.groupBy("depth", "bucket").agg(F.countDistinct("key").alias("k")).collect()
    assert max(r.k for r in sizes) <= 16 and sum(r.k for r in sizes) == 1000
    assert len({r.depth for r in sizes}) > 1  # some buckets split further than others
    held = {(r.key, r.digest) for r in index.collect()}
    assert len(held) == 1000


def test_owners_hold_ranges_of_buckets_and_find_the_copies(spark, monkeypatch):
    """Copies meet in the task that owns their bucket: routed elsewhere, they stay apart."""
    docs = spark.createDataFrame([(i, str(i % 300)) for i in range(1500)], "doc_id bigint, text string").repartition(7)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    kept = spark.conf.get(merging)
    try:
        spark.conf.set(merging, "false")  # a small table would have one owner
        _, index = build_index(docs, bucket_slots=16)
    finally:
        spark.conf.set(merging, kept)
    files = index.select("bucket", "depth", "key", F.input_file_name().alias("f"))
    assert files.groupBy("bucket", "depth").agg(F.countDistinct("f").alias("n")).where("n > 1").isEmpty()
    ranges = files.groupBy("f").agg(F.min("key").alias("a"), F.max("key").alias("b")).collect()
    ends = sorted((r.a, r.b) for r in ranges)
    assert len(ends) > 1 and all(x[1] < y[0] for x, y in zip(ends, ends[1:], strict=False))
    assert index.count() == 300 and {r.n for r in index.select("n").distinct().collect()} == {5}
    one_bucket_each = lambda rows, *a: rows.withColumn("depth", F.lit(64)).withColumn("bucket", F.monotonically_increasing_id())
    monkeypatch.setattr(exact_dedup, "directory_rounds", one_bucket_each)
    _, broken = build_index(docs, bucket_slots=16)
    assert broken.count() > 300


def test_chains_hold_the_digests_of_a_key(spark):
    docs = spark.createDataFrame([(i, str(i % 50)) for i in range(100)], "doc_id bigint, text string")
    _, index = build_index(docs, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2)), bucket_slots=4)
    by_key = index.groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("p"), F.countDistinct("digest").alias("d")).collect()
    assert all(list(r.p) == list(range(r.d)) for r in by_key)


def test_drop_keeps_one_row_of_each_text_and_all_columns(edge):
    kept = drop_duplicates(edge)
    assert kept.columns == edge.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in EDGE})


def test_no_rows(none):
    assert exact_duplicates(none).count() == 0
    assert drop_duplicates(none).count() == 0


def test_runs_no_python(spark, edge):
    plan = exact_duplicates(edge)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
