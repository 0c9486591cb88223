import random

from scanhouse.llm.common import connected_components


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    links += [(1000 + i, 1001 + i) for i in range(60)]  # a long chain
    links += [(2000, 2001 + i) for i in range(100)]  # a star
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    rows = connected_components(df).collect()
    links = [e for e in links if e[0] != e[1]]
    want = brute_components({x for e in links for x in e}, links)
    assert {r.node: r.component for r in rows} == want
    assert len(rows) == len(want)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_key_filter_passes_all_keys_and_few_others(spark):
    from scanhouse.llm.common import key_filter

    keys = spark.range(0, 60_000, 3).selectExpr("id").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id"))
    passes = key_filter(keys, "id", 20_001)
    found = spark.range(0, 60_000).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id")).where(passes("id"))
    assert found.where("id % 3 = 0 or id is null").count() == 20_001
    assert found.where("id % 3 <> 0").count() < 2_000
