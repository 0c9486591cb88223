from datetime import datetime, timedelta

from pyspark.sql import functions as F

from scanhouse.llm.warc import canonical_url, latest_earlier, resolve_revisits

SCHEMA = "record_id bigint, type string, url string, date timestamp, status int, headers map<string,string>, payload string"
T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def test_canonical_urls(spark):
    urls = ["HTTP://WWW.Example.org:80/a?b=2&a=1#x", "https://example.org/a?a=1&b=2", "example.org/a?a=1&b=2", "http://u:p@www2.example.org:443/a?a=1&b=2"]
    rows = spark.createDataFrame([(u,) for u in [*urls, "http://example.org", "http://example.org/", None, ""]], "u string")
    got = [r[0] for r in rows.select(canonical_url(F.col("u"))).collect()]
    assert set(got[:4]) == {"example.org/a?a=1&b=2"}
    assert got[4:7] == ["example.org/", "example.org/", None]


def test_outcomes_and_merged_headers(spark):
    base = {"etag": '"1"', "last-modified": "m1", "content-type": "text/html", "cache-control": "a"}
    rows = [
        (1, "response", "http://x.org/p", at(0), 200, base, "one"),
        (2, "response", "http://www.x.org/p", at(5), 200, base | {"etag": '"2"'}, "two"),
        (3, "response", "http://x.org/p", at(6), 404, {}, "gone"),
        (10, "revisit", "https://x.org/p#f", at(1), 304, {"etag": 'W/"1"', "cache-control": "b", "content-length": "0"}, None),
        (11, "revisit", "http://x.org/p", at(7), 304, {"etag": '"1"'}, None),
        (12, "revisit", "http://x.org/p", at(0), 304, {"etag": '"1"'}, None),
        (13, "revisit", "http://x.org/p", at(8), 304, {"last-modified": "m1"}, None),
        (14, "revisit", "http://x.org/p", at(8), 304, None, None),
        (15, "revisit", None, at(8), 304, {}, None),
        (16, "revisit", "http://x.org/p", None, 304, {}, None),
        (17, "revisit", "http://y.org/", at(8), 304, {}, None),
        (14, "revisit", "http://x.org/p", at(8), 304, None, None),
        (2, "response", "http://www.x.org/p", at(5), 200, base | {"etag": '"2"'}, "two"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS canonical", "2 AS block", "3 AS outcome")
    got = {}
    for r in resolve_revisits(df).collect():
        got.setdefault(r.record_id, []).append(r)
    assert {k: (v[0].outcome, v[0].response_id, v[0].payload) for k, v in got.items()} == {
        10: ("resolved", 1, "one"),
        11: ("changed", 2, None),
        12: ("missing", None, None),
        13: ("resolved", 2, "two"),
        14: ("unvalidated", 2, "two"),
        15: ("missing", None, None),
        16: ("missing", None, None),
        17: ("missing", None, None),
    }
    assert len(got[14]) == 2 and all(len(v) == 1 for k, v in got.items() if k != 14)
    assert got[10][0].headers == base | {"etag": 'W/"1"', "cache-control": "b"} and got[10][0].status == 200
    assert got[11][0].headers == {"etag": '"1"'} and got[11][0].status == 304
    assert got[14][0].headers == base | {"etag": '"2"'}


def test_hot_url_over_many_blocks(spark):
    """One URL in every block of the sort: the last response of earlier blocks is carried on."""
    rows = [(i, "response" if i % 97 == 0 else "revisit", "http://x.org/", at(i), 200 if i % 97 == 0 else 304, {"etag": "e"}, str(i)) for i in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).withColumn("canonical", canonical_url(F.col("url")))
        got = latest_earlier(df).select("record_id", "found.record_id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == sum(i % 97 != 0 for i in range(2000))
    assert all(f == i // 97 * 97 for i, f in got)


def test_no_rows(spark):
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
