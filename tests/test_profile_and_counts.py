"""Exact column profiles by type, and table counts from file footers."""

import datetime as dt
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from scanhouse.operators import sqlops
from scanhouse.operators.sqlops import catalog_inventory, row_count, schema_profile
from scanhouse.plans import fixtures as fx
from tests.conftest import SF_CHECK, SF_SMALL

NAN = float("nan")
DDL = "n int, big bigint, d decimal(12,2), wide decimal(30,3), x double, y float, s string, b binary, t timestamp, day date, f boolean, a array<int>, st struct<p:int,q:string>, nul int"
ROWS = [
    (i % 7 - 3, i * 10**12, Decimal(i % 5) / 4, Decimal(i % 3) * 10**20, [0.0, -0.0, NAN, 1.5][i % 4], [0.0, -0.0, NAN][i % 3], "long " * 20 + str(i % 6) if i % 2 else str(i % 4),
     bytes([i % 3]) * (50 if i % 2 else 2), dt.datetime(2020, 1, 1 + i % 9, 3, 4, 5, i % 2), dt.date(1960 + i % 20, 1, 1), [True, False, None][i % 3], [i % 2, None], (i % 2, None if i % 4 else "q"), None)
    for i in range(200)
]


def brute(df):
    """Distinct values of each column, by the engine's own distinct."""
    out = {}
    for f in df.schema.fields:
        c = df.select(F.col(f"`{f.name}`").alias("c")).where("c is not null")
        out[f.name] = (df.count(), df.count() - c.count(), c.distinct().count())
    return out


def profile(df, **kw):
    return {r["column"]: (r["n_rows"], r["n_null"], r["n_distinct"]) for r in schema_profile(df, **kw).collect()}


@pytest.mark.parametrize("cost", [0, 12, 10**9])
def test_every_type_equals_distinct(spark, monkeypatch, cost):
    monkeypatch.setattr(sqlops, "BITMAP_COST", cost)  # no bitmaps, some, all
    if cost > 12:
        rows = [(r[0], r[1] // 10**12, *r[2:]) for r in ROWS]  # else there are too many bitmaps to hold
    else:
        rows = ROWS
    df = spark.createDataFrame(rows, DDL).repartition(5)
    assert profile(df) == brute(df)


def test_short_and_long_texts_never_meet(spark):
    import hashlib

    long = "x" * 40
    digest = hashlib.sha256(long.encode()).digest()
    df = spark.createDataFrame([(long.encode(),), (digest,), (b"\x01" + digest,), (b"",), (b"\x00",), (None,)], "b binary")
    assert profile(df)["b"] == (6, 1, 5)


def test_no_rows(spark):
    df = spark.createDataFrame([], DDL)
    assert profile(df) == {f.name: (0, 0, 0) for f in df.schema.fields} == profile(df, exact=False)


def shuffled_bytes(df):
    """Bytes that the exchanges of an executed query wrote."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
        if name == "ShuffleExchangeExec":
            total += p.metrics().get("shuffleBytesWritten").get().value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_fewer_bytes_are_moved_than_as_text(spark):
    df = fx.table(spark, SF_CHECK, "lineitem")
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f.name).cast("string").alias("value")) for f in df.schema.fields])
    as_text = df.select(F.inline(cells)).groupBy("column", "value").count().groupBy("column").agg(F.count("value"))
    assert shuffled_bytes(schema_profile(df)) < 0.7 * shuffled_bytes(as_text)


# --- counts


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    name = f"counts_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path_factory.mktemp(name)}'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_counts_come_from_footers(spark, db):
    fx.table(spark, SF_SMALL, "lineitem").repartition(4).write.saveAsTable(f"{db}.lines")
    with sqlops._aggregates_pushed(spark):
        counted = row_count(spark, f"{db}.lines")
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: [COUNT(*)]" in plan, plan
        assert counted.first()[0] == fx.table(spark, SF_SMALL, "lineitem").count()
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_tables_of_every_kind_are_counted(spark, db):
    rows = spark.range(30).selectExpr("id", "id % 3 as part")
    rows.write.format("orc").saveAsTable(f"{db}.orc_rows")
    rows.write.format("json").saveAsTable(f"{db}.json_rows")
    rows.write.partitionBy("part").saveAsTable(f"{db}.parted")
    spark.sql(f"CREATE TABLE {db}.empty (a INT) USING parquet")
    spark.sql(f"CREATE VIEW {db}.some AS SELECT * FROM {db}.parted WHERE part = 1")
    got = {r["table"]: (r["n_columns"], r["n_rows"]) for r in catalog_inventory(spark, [db]).collect()}
    got.pop("lines", None)
    assert got == {"orc_rows": (2, 30), "json_rows": (2, 30), "parted": (2, 30), "empty": (1, 0), "some": (2, 10)}
