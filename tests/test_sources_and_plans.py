"""Sources (index, API docs, catalog, stream) and physical-plan checks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scanhouse.operators import findings as fo
from scanhouse.operators.sqlops import as_records, catalog_inventory, run_sql, schema_profile
from scanhouse.plans import fixtures as fx
from scanhouse.sources.docs import IndexNotInitialised, add_documents, build_index, read_api_docs, read_index, write_index
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_missing_index_is_reported(spark, tmp_dir):
    with pytest.raises(IndexNotInitialised):
        read_index(spark, os.path.join(tmp_dir, "nope"))


def test_index_build_append_and_route(spark, tmp_dir):
    from scanhouse.operators.retrieval import embed, route

    docs_path = os.path.join(tmp_dir, "docs.jsonl")
    with open(docs_path, "w") as f:
        for content, api in [("list all databases", "/list_databases"), ("count findings by severity", "/query_vulnerability_summary")]:
            f.write(json.dumps({"content": content, "api": api}) + "\n")
    docs = read_api_docs(spark, docs_path).withColumn("doc_id", F.monotonically_increasing_id())
    path = os.path.join(tmp_dir, "index")
    write_index(build_index(docs, dim=64), path)
    extra = spark.createDataFrame([(100, "explain a rule by check id", "/explain", ["check_id"])],
                                  "doc_id long, content string, api string, required_fields array<string>")
    add_documents(spark, path, extra, dim=64)
    index = read_index(spark, path)
    assert index.count() == 3
    qs = embed(spark.createDataFrame([(1, "explain this rule"), (2, "databases list")], "query_id long, text string"), "text", 64)
    got = {r["query_id"]: (r["api"], r["required_fields"]) for r in route(qs, index).collect()}
    assert got == {1: ("/explain", ["check_id"]), 2: ("/list_databases", [])}


def test_catalog_inventory_skips_temp_views(spark):
    db = fx.register_catalog(spark, SF_SMALL, db="inv_test")
    spark.range(3).createOrReplaceTempView("some_temp_view")
    rows = {r["table"]: r for r in catalog_inventory(spark, [db]).collect()}
    assert "some_temp_view" not in rows
    assert rows["lineitem"]["n_rows"] == 6000 and rows["lineitem"]["n_columns"] == 11


def test_schema_profile_exact_and_approx(spark):
    li = fx.table(spark, SF_SMALL, "lineitem")
    exact = {r["column"]: r for r in schema_profile(li).collect()}
    approx = {r["column"]: r for r in schema_profile(li, exact=False).collect()}
    assert set(exact) == set(approx) == set(li.columns)
    for c in li.columns:
        assert exact[c]["n_rows"] == approx[c]["n_rows"] == 6000
        # HLL++ with rsd 0.05: allow three standard deviations
        assert abs(exact[c]["n_distinct"] - approx[c]["n_distinct"]) <= max(2, 0.15 * exact[c]["n_distinct"])


def test_as_records_rejects_duplicate_names(spark):
    df = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("a"))
    with pytest.raises(ValueError):
        as_records(df)


def test_run_sql_binds_parameters(spark):
    fx.register_views(spark, SF_SMALL)
    evil = "High' OR '1'='1"
    assert run_sql(spark, "SELECT COUNT(*) AS n FROM findings WHERE security_severity = :v", {"v": evil}).first()["n"] == 0


def test_stream_second_run_loads_nothing(spark, tmp_dir):
    from scanhouse.streaming.ingest import read_ingested, start_ingest

    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    fx.reports(spark, SF_SMALL).write.json(src)
    start_ingest(spark, src, out, ck, layout="lines", db="t_stream").awaitTermination()
    n1 = read_ingested(spark, out, "scan_results").count()
    start_ingest(spark, src, out, ck, layout="lines", db="t_stream").awaitTermination()
    assert read_ingested(spark, out, "scan_results").count() == n1 == 6000
    assert fo.severity_counts(spark.table("t_stream.scan_results")).agg(F.sum("count")).first()[0] == 6000
    assert read_ingested(spark, out, "scan_rejects").count() == 0


# ---------------------------------------------------------------- plan checks


def test_filter_and_projection_reach_the_scan(spark, tmp_dir):
    path = os.path.join(tmp_dir, "scan_results")
    fx.findings(spark, SF_SMALL).write.parquet(path)
    top = fo.high_severity_files(spark.read.parquet(path))
    plan = _plan(top)
    assert "TakeOrderedAndProject" in plan
    assert "PushedFilters: [IsNotNull(security_severity), EqualTo(security_severity,High)]" in plan
    assert "ReadSchema: struct<path:string,security_severity:string>" in plan


def test_aggregates_are_partial_then_final(spark):
    plan = _plan(fo.cwe_summary(fx.findings(spark, SF_SMALL)))
    assert plan.count("HashAggregate") >= 2 or "partial_count" in plan


def test_flatten_is_narrow(spark):
    from scanhouse.operators.flatten import flatten_results

    reports = fx.reports(spark, SF_SMALL)
    flat = flatten_results(reports)
    # only the fixture's own aggregate/join shuffle; flattening adds none
    assert _plan(flat).count("Exchange") == _plan(reports).count("Exchange")


def test_stream_index_load_once_and_new_files(spark, tmp_dir):
    from scanhouse.streaming.index_load import start_index_load

    src, idx, ck = (os.path.join(tmp_dir, x) for x in ("docs", "index", "ck"))
    os.makedirs(src)
    with open(os.path.join(src, "a.jsonl"), "w") as f:
        f.write(json.dumps({"content": "list all tables", "api": "/list_tables"}) + "\n")
        f.write(json.dumps({"content": "describe one table", "api": "/describe_table", "required_fields": ["table"]}) + "\n")
    start_index_load(spark, src, idx, ck, dim=32).awaitTermination()
    start_index_load(spark, src, idx, ck, dim=32).awaitTermination()
    assert read_index(spark, idx).count() == 2
    with open(os.path.join(src, "b.jsonl"), "w") as f:
        f.write(json.dumps({"doc_id": 7, "content": "suggest a fix", "api": "/suggest_fix"}) + "\n")
    start_index_load(spark, src, idx, ck, dim=32).awaitTermination()
    rows = {r["api"]: r for r in read_index(spark, idx).collect()}
    assert set(rows) == {"/list_tables", "/describe_table", "/suggest_fix"}
    assert rows["/suggest_fix"]["doc_id"] == 7 and rows["/describe_table"]["required_fields"] == ["table"]


def test_staged_reports_prune_to_the_column_each_flattening_needs(spark):
    from scanhouse.operators.flatten import flatten_errors, flatten_results, report_summary
    from scanhouse.plans.ingest import stage_reports

    staged, _ = stage_reports(fx.reports(spark, SF_SMALL))

    def read_schema(df):
        plan = _plan(df)
        i = plan.find("ReadSchema: ")
        return plan[i + len("ReadSchema: "): plan.find("\n", i)]

    assert read_schema(flatten_errors(staged)).startswith("struct<errors:")
    assert "results" not in read_schema(flatten_errors(staged))
    assert read_schema(flatten_results(staged)).startswith("struct<results:")
    assert "errors" not in read_schema(flatten_results(staged))
    assert read_schema(report_summary(staged)) == "struct<version:string,paths:struct<scanned:array<string>>,skipped_rules:array<string>>"


def test_describe_table_returns_schema_json(spark):
    from scanhouse.operators.sqlops import describe_table

    db = fx.register_catalog(spark, SF_SMALL, db="inv_test")
    schema = json.loads(describe_table(spark, f"{db}.orders"))
    assert schema["type"] == "struct"
    assert [f["name"] for f in schema["fields"]][:2] == ["o_orderkey", "o_custkey"]


def test_index_batches_are_all_read_in_any_order(spark, tmp_dir):
    from scanhouse.streaming.index_load import start_index_load

    def docs(first, n):
        return spark.createDataFrame([(first + i, f"text {first + i}", "/a") for i in range(n)], "doc_id long, content string, api string")

    src = os.path.join(tmp_dir, "docs")
    docs(100, 1).write.json(src)
    for name in ("build-first", "stream-first"):
        path, ck = (os.path.join(tmp_dir, f"{name}-{x}") for x in ("index", "ck"))
        load = lambda: start_index_load(spark, src, path, ck, dim=16).awaitTermination()  # noqa: B023, E731
        if name == "build-first":
            write_index(build_index(docs(0, 5), dim=16), path)
            load()
        else:
            load()
            add_documents(spark, path, docs(0, 5), dim=16)
        load()
        assert sorted(r["doc_id"] for r in read_index(spark, path).collect()) == [0, 1, 2, 3, 4, 100]
        write_index(build_index(docs(7, 2), dim=16), path)  # overwrites them all
        assert sorted(r["doc_id"] for r in read_index(spark, path).collect()) == [7, 8]


def test_records_keep_nulls(spark):
    assert as_records(spark.createDataFrame([(None, 1)], "cwe string, cnt int")).first()["record"] == '{"cwe":null,"cnt":1}'


def test_profile_of_empty_and_odd_columns(spark):
    empty = spark.createDataFrame([], "a int, b string")
    for exact in (True, False):
        rows = schema_profile(empty, exact=exact).collect()
        assert sorted((r["column"], r["n_rows"], r["n_null"], r["n_distinct"]) for r in rows) == [("a", 0, 0, 0), ("b", 0, 0, 0)]
    odd = spark.createDataFrame([(-0.0, bytearray(b"\xff")), (0.0, bytearray(b"\xfe")), (None, None)], "x double, y binary")
    assert {r["column"]: (r["n_null"], r["n_distinct"]) for r in schema_profile(odd).collect()} == {"x": (1, 1), "y": (1, 2)}


def test_inventory_quotes_names(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS `order`")
    spark.range(3).write.mode("overwrite").saveAsTable("`order`.`select`")
    try:
        assert [tuple(r) for r in catalog_inventory(spark, ["order"]).collect()] == [("order", "select", 1, 3)]
    finally:
        spark.sql("DROP DATABASE `order` CASCADE")
