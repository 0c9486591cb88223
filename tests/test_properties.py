"""Properties of the finding, retrieval and dialogue operators on driver data and small frames."""

import pytest
from pyspark.sql import functions as F

from scanhouse.operators import dialog as dl
from scanhouse.operators import findings as fo
from scanhouse.operators.flatten import flatten_results
from scanhouse.operators.retrieval import embed, route, similarity_search, term_counts
from scanhouse.plans import fixtures as fx
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def findings(spark):
    return fx.findings(spark, SF_SMALL).cache()


def test_severity_counts_sum_to_total(findings):
    total = findings.count()
    assert sum(r["count"] for r in fo.severity_counts(findings).collect()) == total
    assert {r["total"] for r in fo.vulnerability_summary(findings).collect()} == {total}


def test_cwe_totals_cover_all_findings(findings):
    rows = fo.findings_by_cwe(findings).collect()
    per_cwe = {}
    for r in rows:
        per_cwe.setdefault(r["cwe"], set()).add(r["total_count"])
    assert all(len(v) == 1 for v in per_cwe.values())
    assert None in per_cwe  # NULL is a group
    assert sum(next(iter(v)) for v in per_cwe.values()) == findings.count()


def test_nest_then_explode_is_identity(spark, findings):
    flat = flatten_results(fx.reports(spark, SF_SMALL))
    cols = [c for c in flat.columns if c != "owasp"]
    assert flat.select(cols).exceptAll(findings.select(cols)).count() == 0
    assert findings.select(cols).exceptAll(flat.select(cols)).count() == 0


def test_explain_check_pages_keep_every_occurrence(findings):
    nested = fo.explain_check(findings, page_size=7)
    n_pages = nested.groupBy("check_id").agg(F.count("*").alias("p")).agg(F.max("p")).first()[0]
    assert n_pages > 1  # hot rules are split
    flat = nested.select("check_id", F.explode("occurrences").alias("o")).select("check_id", "o.*")
    ref = findings.select("check_id", *fo.OCCURRENCE_COLS)
    assert flat.exceptAll(ref).count() == 0 and ref.exceptAll(flat).count() == 0
    assert nested.select("check_id", "message").distinct().count() == findings.select("check_id").distinct().count()


def test_absent_ids_give_fixed_rows(findings):
    fc = fo.fix_context(findings, check_id="no.such.rule").collect()
    assert [(r["check_id"], r["shortDescription"], r["message"]) for r in fc] == [("no.such.rule", "", fo.FIX_NOT_FOUND)]
    ex = fo.explain_check(findings, check_id="no.such.rule").collect()
    assert len(ex) == 1 and ex[0]["message"] == fo.NO_CHECK_INFO and ex[0]["occurrences"] == []


def test_headline_when_no_high_files(findings):
    none = fo.high_severity_headline(fo.high_severity_files(findings, level="Nope")).collect()
    assert none[0]["summary"] == fo.NO_HIGH_FILES


def test_cwe_normalize_and_id_match(spark):
    df = spark.createDataFrame(
        [("a", '["CWE-1","CWE-2"]'), ("b", '[ "CWE-1", "CWE-2" ]'), ("a", "CWE-1: title"), ("c", None)], "path string, cwe string"
    )
    assert fo.cwe_summary(df).count() == 4
    assert fo.cwe_summary(df, normalize=True).count() == 3
    by_id = fo.findings_by_cwe(df, cwe_id="CWE-1", match="id").collect()
    assert sorted((r["path"], r["count"], r["total_count"]) for r in by_id) == [("a", 2, 3), ("b", 1, 3)]
    second = fo.findings_by_cwe(df, cwe_id="CWE-2", match="id").collect()  # any id of a finding counts
    assert sorted((r["path"], r["count"], r["total_count"]) for r in second) == [("a", 1, 2), ("b", 1, 2)]
    assert fo.filter_cwe(df, "CWE-2", match="id").count() == 2 and fo.filter_cwe(df, "CWE-1: title").count() == 1


def test_self_is_nearest_at_distance_zero(spark):
    e = fx.table(spark, SF_SMALL, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    d = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    # small blocks force many tiles: the result must not depend on the tiling
    top = similarity_search(q, d, k=2, block_rows=64).where("rank = 1")
    assert top.where("query_id <> doc_id OR distance <> 0").count() == 0
    one_tile = similarity_search(q, d, k=2, block_rows=100000)
    many = similarity_search(q, d, k=2, block_rows=64)
    assert one_tile.exceptAll(many).count() == 0 and many.exceptAll(one_tile).count() == 0


def test_search_plan_has_no_cartesian_product(spark):
    e = fx.table(spark, SF_SMALL, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    d = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    plan = similarity_search(q, d, k=1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "FlatMapCoGroupsInArrow" in plan


def test_route_empty_index_keeps_queries(spark):
    qs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<float>")
    idx = spark.createDataFrame([], "doc_id long, api string, vector array<float>")
    rows = route(qs, idx).collect()
    assert sorted((r["query_id"], r["found"], r["required_fields"]) for r in rows) == [(1, False, []), (2, False, [])]


def test_embed_dense_agrees_with_sparse_counts(spark):
    docs = fx.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    dense = embed(docs, "text", dim=64).select("doc_id", F.posexplode("vector").alias("bucket", "w")).where("w <> 0")
    sparse = term_counts(docs, "doc_id", "text", dim=64).select("doc_id", "bucket", F.col("weight").cast("float").alias("w"))
    assert dense.exceptAll(sparse).count() == 0 and sparse.exceptAll(dense).count() == 0


def test_embed_with_model_factory(spark):
    import numpy as np

    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    docs = spark.createDataFrame([(1, "abc"), (2, "")], "id long, text string")
    rows = embed(docs, "text", model_factory=factory).orderBy("id").collect()
    assert [list(r["vector"]) for r in rows] == [[3.0, 1.0], [0.0, 1.0]]


def test_history_window_k2_and_system_rows(spark):
    conv = spark.createDataFrame(
        [(1, 0, "system", "S"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "system", "S2"),
         (1, 4, "user", "u2"), (1, 5, "assistant", "a2"), (1, 6, "user", "u3")],
        "conv_id long, turn long, role string, text string",
    )
    for partitions in (1, 3, 7):
        h = {r["turn"]: r["history"] for r in dl.history_window(conv, k=2, partitions=partitions).collect()}
        assert h[1] == ""
        assert h[4] == "Human: u1\nAI: a1"
        assert h[6] == "Human: u1\nAI: a1\nHuman: u2\nAI: a2"
        assert 0 not in h and 3 not in h


def test_build_messages_skips_empty_history(spark):
    df = spark.createDataFrame([("sys", "", "hi"), ("sys", "Human: a\nAI: b", "next")], "s string, history string, text string")
    rows = dl.build_messages(df, "s").collect()
    assert [[(m["role"], m["content"]) for m in r["messages"]] for r in rows] == [
        [("system", "sys"), ("user", "hi")],
        [("system", "sys"), ("user", "Human: a\nAI: b"), ("user", "next")],
    ]


def test_parse_reply_kinds(spark):
    bodies = [
        (1, None),
        (2, "plain words"),
        (3, '{"missing_params": null, "api": "/x", "params": {}}'),
        (4, '{"api": "/x", "params": {"table": "t", "n": 5}}'),
        (5, '["api", "params"]'),
        (6, '{"api": "/x"}'),
        (7, "42"),
    ]
    df = spark.createDataFrame(bodies, "id int, body string")
    out = {r["id"]: r for r in dl.parse_reply(df).collect()}
    assert {i: out[i]["kind"] for i in out} == {
        1: "empty", 2: "text", 3: "missing", 4: "call", 5: "unexpected", 6: "unexpected", 7: "unexpected",
    }
    assert out[4]["api"] == "/x" and out[4]["params"] == {"table": "t", "n": "5"}


def test_missing_fields_and_classify(spark):
    df = spark.createDataFrame(
        [
            (1, 422, '{"detail": [{"type": "missing", "loc": ["body", "table"]}, {"type": "missing", "loc": []}, {"type": "x", "loc": ["q"]}]}'),
            (2, 422, '{"detail": "Not authenticated"}'),
            (3, 422, "not json"),
            (4, 200, '{"ok": 1}'),
            (5, 500, "boom"),
        ],
        "id int, status int, body string",
    )
    mf = {r["id"]: r["m"] for r in df.select("id", dl.missing_fields(F.col("body")).alias("m")).collect()}
    assert mf == {1: ["table", None], 2: [], 3: [], 4: [], 5: []}
    kinds = {r["id"]: (r["kind"], r["message"]) for r in dl.classify_response(df).collect()}
    assert kinds[1][0] == "needs_arguments" and kinds[2][0] == "needs_arguments"
    assert kinds[3] == ("failed", "API 呼叫失敗: 422, not json")
    assert kinds[4] == ("ok", '{"ok": 1}') and kinds[5] == ("failed", "API 呼叫失敗: 500, boom")
    strict = {r["id"]: r["kind"] for r in dl.classify_response(df, require_missing=True).collect()}
    assert strict[1] == "needs_arguments" and strict[2] == "failed"


def test_blank_required_and_merge_payload(spark):
    df = spark.createDataFrame(
        [(1, {"a": " ", "b": "x"}), (2, None)], "id int, payload map<string,string>"
    )
    req = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    out = {r["id"]: r["blank"] for r in df.select("id", dl.blank_required(req, F.col("payload")).alias("blank")).collect()}
    assert out == {1: ["a", "c"], 2: ["a", "b", "c"]}
    extra = F.create_map(F.lit("b"), F.lit("y"), F.lit("c"), F.lit("z"))
    merged = {r["id"]: r["m"] for r in df.select("id", dl.merge_payload(F.col("payload"), extra).alias("m")).collect()}
    assert merged == {1: {"a": " ", "b": "y", "c": "z"}, 2: {"b": "y", "c": "z"}}


def test_repair_prompt_mentions_api_and_error(spark):
    df = spark.createDataFrame([("/q", '{"detail": []}')], "api string, body string")
    p = dl.repair_prompt(df).first()["system_prompt"]
    assert "/q" in p and '{"detail": []}' in p and "missing_params" in p and "params" in p


def test_findings_by_cwe_nested_pages_keep_every_file(findings):
    nested = fo.findings_by_cwe_nested(findings, page_size=5)
    flat = nested.select("cwe", "total_count", F.explode("files").alias("f")).select("cwe", "f.path", "f.count", "total_count")
    ref = fo.findings_by_cwe(findings)
    assert flat.exceptAll(ref).count() == 0 and ref.exceptAll(flat).count() == 0
    assert nested.groupBy("cwe").count().agg(F.max("count")).first()[0] > 1


def test_explain_check_counts_equal_findings(spark):
    copies = spark.range(0, 1000, 1, 4).select(  # 1000 identical findings
        F.lit("r").alias("check_id"), F.lit("p").alias("path"),
        *[F.lit(v).cast("long").alias(c) for c, v in
          [("start_line", 1), ("start_col", 1), ("end_line", 2), ("end_col", 2), ("start_offset", 0), ("end_offset", 0)]],
        F.lit("m").alias("message"),
    )
    pages = fo.explain_check(copies, page_size=100).select(F.size("occurrences").alias("n")).collect()
    assert [r["n"] for r in pages] == [1000]  # equal findings share a page; they are shuffled as one counted row


def test_hot_rule_results_and_plans(spark, findings):
    from pyspark.sql import Window

    # a third of all findings belong to one rule
    hot = findings.withColumn(
        "check_id", F.when(F.pmod(F.xxhash64("report_id", "start_line"), F.lit(3)) == 0, F.lit("rule.hot")).otherwise(F.col("check_id"))
    )
    flat = fo.explain_check_flat(hot)
    order = [F.col(c) for c in fo.OCCURRENCE_COLS + ["start_offset", "end_offset", "message"]]
    ref_msg = (
        hot.withColumn("rn", F.row_number().over(Window.partitionBy("check_id").orderBy(*order)))
        .where("rn = 1")
        .select("check_id", F.col("message").alias("m"))
    )
    ref = hot.join(ref_msg, "check_id").select("check_id", F.col("m").alias("message"), *fo.OCCURRENCE_COLS)
    assert flat.exceptAll(ref).count() == 0 and ref.exceptAll(flat).count() == 0
    for df in (flat, fo.fix_context(hot), fo.findings_by_cwe(hot), fo.severity_counts(hot)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan  # no window keyed by the hot rule over raw rows
        assert df is flat or "partial_" in plan  # map-side combine before every shuffle of raw rows
    pages = fo.explain_check(hot, page_size=500).where("check_id = 'rule.hot'")
    assert pages.count() > 1
    assert pages.select(F.sum(F.size("occurrences"))).first()[0] == hot.where("check_id = 'rule.hot'").count()


def test_parse_reply_repeated_keys_keep_last_value(spark):
    df = spark.createDataFrame(
        [(1, '{"api": "/a", "api": "/b", "params": {}}'), (2, '{"missing_params": ["t"], "missing_params": ["u"]}'),
         (3, '{"api": "/x", "params": {"n": NaN}}')],
        "id int, body string",
    )
    out = {r["id"]: r for r in dl.parse_reply(df).collect()}
    assert (out[1]["kind"], out[1]["api"]) == ("call", "/b")
    assert (out[2]["kind"], out[2]["missing"]) == ("missing", ["u"])
    assert out[3]["kind"] == "call"  # NaN counts as JSON, as a Python parser takes it


def test_keep_unmatched_only_when_no_hit(spark):
    qs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "query_id long, vector array<float>")
    idx = spark.createDataFrame([(10, [0.0, 0.1]), (11, [1.0, 0.9]), (12, [5.0, 5.0])], "doc_id long, vector array<float>")
    hits = similarity_search(qs, idx, k=2, keep_unmatched=True, block_rows=1).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in hits) == [(1, 1, 10), (1, 2, 11), (2, 1, 11), (2, 2, 10)]
    none = similarity_search(qs, idx.where("false"), k=2, keep_unmatched=True).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"], r["distance"]) for r in none) == [(1, 1, None, None), (2, 1, None, None)]


JSON_TEXTS = [
    '{"a":1} xyz', '{"a":1}{"b":2}', "{'a':1}", '{"a":"x\ny"}', '{"a":1,"a":2}', '[{"a":1,"a":2}]', '{"a":NaN}', "NaN", '{"a":01}', '"x"',
    "1 2", "", "  ", '  {"a":1} \n', '{"a":-Infinity}', '{"a":1,}', "[1,]", '{"a":.5}', '{"a":1e5}', '{"a":"\\x"}', "nul", "null", '/*c*/{"a":1}',
    '\ufeff{"a":1}', "{a:1}", '{"a":1}\xa0', '"\t"', '{"a":{"b":1,"b":2}}', "[1] x", "-", '"a" "b"', "1],[2", "1}", '1,"w":2', "1,2", '{"a":1}]', "]",
    "true", "[]", "{}", '"a":1',
]


def test_json_is_what_a_strict_parser_takes(spark):
    import json

    def parsed(text):
        try:
            return True, json.loads(text)
        except ValueError:
            return False, None

    df = spark.createDataFrame([(t,) for t in JSON_TEXTS], "body string")
    for r in df.select("body", dl.is_json(F.col("body")).alias("ok"), dl.json_keys(F.col("body")).alias("keys")).collect():
        ok, value = parsed(r["body"])
        assert r["ok"] == ok, r["body"]
        assert set(r["keys"] or []) == (set(value) if isinstance(value, dict) else set()), r["body"]


def test_replies_and_responses_with_text_around_the_json(spark):
    df = spark.createDataFrame(
        [(1, '{"api": "/x", "params": {}} Here is the call.'), (2, '{"missing_params": "t", "message": "Which?", "more": 1}'), (3, "[1]")],
        "id int, body string",
    )
    out = {r["id"]: r for r in dl.parse_reply(df).collect()}
    assert out[1]["kind"] == "text" and out[1]["raw"] is None
    assert (out[2]["kind"], out[2]["missing"], out[2]["message"], out[2]["raw"]) == ("missing", None, "Which?", df.collect()[1]["body"])
    assert (out[3]["kind"], out[3]["raw"]) == ("unexpected", "[1]")
    df = spark.createDataFrame([(1, 200, '{"a":1}<html>'), (2, 422, '{"detail": []} more'), (3, 200, '[{"a":1,"a":2}]'), (4, 422, '{"detail": null}')], "id int, status int, body string")
    out = {r["id"]: (r["kind"], r["message"]) for r in dl.classify_response(df).collect()}
    assert out[1][0] == "failed" and out[2][0] == "failed" and out[3] == ("ok", '[{"a":1,"a":2}]') and out[4] == ("needs_arguments", "null")


def test_blank_means_any_white_space(spark):
    df = spark.createDataFrame([({"a": "\t\n", "b": "\u3000", "c": " x "},)], "payload map<string,string>")
    fields = F.array(*map(F.lit, "abcd"))
    assert df.select(dl.blank_required(fields, F.col("payload"))).first()[0] == ["a", "b", "d"]
    assert df.select(dl.merge_payload(F.col("payload"), F.lit(None).cast("map<string,string>"))).first()[0]["c"] == " x "


def test_history_of_a_hot_conversation_with_any_turn_numbers(spark):
    """A third of the rows in one conversation, irregular turns, one far outlier."""
    rows = [(0, i * 1_000_003 + i * i % 997, "user" if i % 2 else "assistant", f"m{i}") for i in range(3000)]
    rows += [(0, 10**15, "user", "last")] + [(1 + i // 5, i % 5, "user", f"c{i}") for i in range(6000)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    one, many = (dl.history_window(conv, k=2, partitions=n) for n in (1, 9))
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    got = {r["text"]: r["history"] for r in many.where("conv_id = 0").collect()}
    assert got["last"] == "\n".join(f"{'Human' if i % 2 else 'AI'}: m{i}" for i in range(2996, 3000))
    shares = conv.repartitionByRange(9, "conv_id", "turn").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert shares < 2500  # the cut follows the rows, not the turn numbers


def test_empty_and_absent_findings(spark, findings):
    none = findings.where("false")
    assert [tuple(r) for r in fo.vulnerability_summary(none).collect()] == [(None, 0, 0)]
    assert fo.severity_counts(none).count() == 0
    assert [tuple(r) for r in fo.findings_by_cwe(findings, cwe_id="CWE-0").collect()] == [("CWE-0", None, 0, 0)]
    assert [tuple(r) for r in fo.findings_by_cwe_nested(findings, cwe_id="CWE-0").collect()] == [("CWE-0", 0, 0, [])]
    assert fo.explain_check(findings).groupBy("check_id").count().agg(F.max("count")).first()[0] == 1


def test_rule_messages_do_not_move_the_findings(findings):
    plan = fo.explain_check_flat(findings)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(check_id" not in plan


def test_text_vectors_take_one_scan_and_no_shuffle(spark):
    docs = fx.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    for df in (term_counts(docs, "doc_id", "text"), embed(docs, "text")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_term_counts_of_any_row(spark):
    docs = spark.createDataFrame([(-1, None), (-2, ""), (None, "a b a"), (7, "a"), (7, "b"), (8, "Σ'Α " * 200_000)], "doc_id long, text string")
    rows = term_counts(docs, "doc_id", "text", dim=64).collect()
    assert sum(r["tf"] for r in rows if r["doc_id"] is None) == 3
    assert sorted(r["tf"] for r in rows if r["doc_id"] == 7) == [1, 1]
    assert sum(r["tf"] for r in rows if r["doc_id"] == 8) == 400_000


def brute_nearest(q, d, k):
    import numpy as np

    dist = ((q[:, None, :] - d[None, :, :]) ** 2).sum(axis=2)
    return [[(int(j), round(float(row[j]), 6)) for j in np.lexsort((np.arange(len(d)), row))[:k]] for row in dist]


@pytest.mark.parametrize("block_rows", [16, 10_000])
def test_search_equals_brute_force_on_clusters(spark, block_rows):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 20
    d = centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 8))
    d[50:80] = d[3]  # equal rows: ties go to the smaller id
    q = np.concatenate([d[:40], centres + 0.5, rng.normal(size=(30, 8)) * 30])
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query_id string, vector array<double>").repartition(3)
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "doc_id long, vector array<double>").repartition(4)
    got = similarity_search(queries, index, k=5, block_rows=block_rows).orderBy("query_id", "rank").collect()
    want = brute_nearest(q, d, 5)
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append((r["doc_id"], r["distance"]))
    assert by_query == {f"q{i}": w for i, w in enumerate(want)}


def test_search_ranks_by_raw_distance_and_takes_any_ids(spark):
    index = spark.createDataFrame([("b", [0.0, 0.0]), ("c", [0.0003, 0.0]), ("x", None), ("y", [1.0]), ("z", [float("nan"), 0.0])], "doc_id string, vector array<double>")
    queries = spark.createDataFrame([("q", [0.0003, 0.0]), ("q", [0.0, 0.0]), ("n", None), ("w", [1.0, 2.0, 3.0])], "query_id string, vector array<double>")
    hits = similarity_search(queries, index, k=1).collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in hits) == [("q", "b"), ("q", "c")]
    every = similarity_search(queries, index, k=1, keep_unmatched=True).collect()
    assert sorted((r["query_id"], r["doc_id"] or "") for r in every) == [("n", ""), ("q", "b"), ("q", "c"), ("w", "")]
