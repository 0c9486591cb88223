"""Registered queries: name -> (spark, sf_dir) -> DataFrame, all over whole driver tables.

Array-valued outputs are rendered as text (``array_join``) where the query is
checked against DuckDB, so both engines hash the same scalar values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanhouse.functions.partitioning import spread
from scanhouse.operators import findings as fo
from scanhouse.operators.flatten import flatten_error_spans, flatten_errors, flatten_results, report_summary
from scanhouse.plans import fixtures as fx
from scanhouse.plans.ingest import ingest_reports
from scanhouse.session import delete_folder, ensure_checkpoint_dir, scratch_dir, shuffles_dropped, write_scratch
from scanhouse.sources.reports import read_reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


def _flat_text(df: DataFrame) -> DataFrame:
    return df.withColumn("owasp", F.array_join("owasp", ","))


def _content(frames: dict[str, DataFrame]) -> DataFrame:
    """``table_name, row``: every row of several tables as one text, so that content is compared."""

    def text(f):
        c = F.array_join(f.name, ",") if f.dataType.simpleString().startswith("array") else F.col(f.name).cast("string")
        return F.coalesce(c, F.lit("~"))

    rows = [df.select(F.lit(n).alias("table_name"), F.concat_ws("|", *map(text, df.schema.fields)).alias("row")) for n, df in frames.items()]
    return reduce(DataFrame.unionByName, rows)


def _finished(df: DataFrame, folders: list[str], dbs: list[str] = (), packed: bool = False) -> DataFrame:
    """The result, checkpointed, once the scratch tables and folders that it came from are gone. ``packed``: as
    compressed parquet, for results as large as what was loaded, in no order."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = write_scratch(df, scratch_dir(spark, "result")) if packed else df.checkpoint()
    for db in dbs:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")
    for folder in folders:
        delete_folder(spark, folder)
    return kept


def _json_files(reports: DataFrame, path: str, *by: str) -> str:
    """Reports as a scanner's JSON Lines files, compressed (quickly: JSON repeats its keys); their folder."""
    with shuffles_dropped(reports.sparkSession):
        reports.write.partitionBy(*by).options(**PACKED).json(path)
    return path


#: How report files are compressed; any reader knows it by their names.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


# ---------------------------------------------------------------- findings reports


@register("high_severity_files")
def q_high_severity_files(spark, sf_dir):
    return fo.high_severity_files(fx.findings(spark, sf_dir), top_n=50)


@register("severity_counts")
def q_severity_counts(spark, sf_dir):
    return fo.severity_counts(fx.findings(spark, sf_dir))


@register("vulnerability_summary")
def q_vulnerability_summary(spark, sf_dir):
    return fo.vulnerability_summary(fx.findings(spark, sf_dir))


@register("high_severity_headline")
def q_high_severity_headline(spark, sf_dir):
    return fo.high_severity_headline(fo.high_severity_files(fx.findings(spark, sf_dir), top_n=50))


@register("cwe_summary")
def q_cwe_summary(spark, sf_dir):
    return fo.cwe_summary(fx.findings(spark, sf_dir))


@register("explain_check")
def q_explain_check(spark, sf_dir):
    """One row per rule, the occurrence arrays rendered as JSON text for the SQL check."""
    ex = fo.explain_check(fx.findings(spark, sf_dir))
    return ex.withColumn("occurrences", F.to_json("occurrences"))


@register("explain_check_flat")
def q_explain_check_flat(spark, sf_dir):
    return fo.explain_check_flat(fx.findings(spark, sf_dir))


@register("explain_check_one")
def q_explain_check_one(spark, sf_dir):
    return fo.explain_check_flat(fx.findings(spark, sf_dir), check_id="rule.7")


@register("explain_check_absent")
def q_explain_check_absent(spark, sf_dir):
    return fo.explain_check_flat(fx.findings(spark, sf_dir), check_id="rule.absent")


@register("findings_by_cwe")
def q_findings_by_cwe(spark, sf_dir):
    return fo.findings_by_cwe(fx.findings(spark, sf_dir))


@register("findings_by_cwe_one")
def q_findings_by_cwe_one(spark, sf_dir):
    return fo.findings_by_cwe(fx.findings(spark, sf_dir), cwe_id="CWE-107")


@register("findings_by_cwe_absent")
def q_findings_by_cwe_absent(spark, sf_dir):
    return fo.findings_by_cwe(fx.findings(spark, sf_dir), cwe_id="CWE-0")


@register("findings_by_cwe_nested")
def q_findings_by_cwe_nested(spark, sf_dir):
    """The tool's shape, one row per CWE, the file arrays rendered as JSON text."""
    return fo.findings_by_cwe_nested(fx.findings(spark, sf_dir)).withColumn("files", F.to_json("files"))


@register("fix_context")
def q_fix_context(spark, sf_dir):
    return fo.fix_context(fx.findings(spark, sf_dir))


@register("fix_context_one")
def q_fix_context_one(spark, sf_dir):
    return fo.fix_context(fx.findings(spark, sf_dir), check_id="rule.7")


# ---------------------------------------------------------------- ingestion


@register("flatten_results")
def q_flatten_results(spark, sf_dir):
    return _flat_text(flatten_results(fx.reports(spark, sf_dir)))


@register("flatten_errors")
def q_flatten_errors(spark, sf_dir):
    return flatten_errors(fx.reports(spark, sf_dir))


@register("flatten_error_spans")
def q_flatten_error_spans(spark, sf_dir):
    return flatten_error_spans(fx.reports(spark, sf_dir))


@register("report_summary")
def q_report_summary(spark, sf_dir):
    s = report_summary(fx.reports(spark, sf_dir))
    return s.select("version", F.array_join("scanned", ",").alias("scanned"), F.array_join("skipped_rules", ",").alias("skipped_rules"))


@register("read_reports")
def q_read_reports(spark, sf_dir):
    """Reports written as JSON Lines to the shared scratch folder, read back with the fixed schema."""
    path = _json_files(fx.reports(spark, sf_dir), scratch_dir(spark, "reports-json"))
    return _finished(_flat_text(flatten_results(read_reports(spark, path, layout="lines"))), [path], packed=True)


@register("read_reports_multiline")
def q_read_reports_multiline(spark, sf_dir):
    """The scanner's own format: one pretty-printed document per file, a few hundred findings each."""
    path = scratch_dir(spark, "reports-documents")
    merged = fx.order_lines(spark, sf_dir).groupBy(F.floor(F.col("o_orderkey") / 400).alias("scan"))
    merged = merged.agg(F.flatten(F.collect_list("lines")).alias("lines"))  # findings are built where a document is written
    document = F.to_json(F.struct(F.lit("1.0").alias("version"), fx.results_of("lines").alias("results")), {"pretty": "true"}).alias("value")
    with shuffles_dropped(spark):
        merged.select("scan", document).write.partitionBy("scan").options(**PACKED).text(path)
    return _finished(_flat_text(flatten_results(read_reports(spark, f"{path}/*"))), [path], packed=True)


def _loaded(spark, sf_dir, loads: int, **options) -> DataFrame:
    """Report files ingested ``loads`` times into four fresh tables: the tables' content."""
    src, loc = _json_files(fx.reports(spark, sf_dir), scratch_dir(spark, "reports-files")), scratch_dir(spark, "warehouse")
    db = f"scanhouse_{uuid.uuid4().hex[:12]}"
    for _ in range(loads):
        names = ingest_reports(spark, partial(read_reports, spark, src, layout="lines", with_source=True), db, "parquet", loc, **options)
    delete_folder(spark, src)
    return _finished(_content({n.split(".")[-1]: spark.table(n) for n in names}), [loc], [db], packed=True)


@register("ingest_roundtrip")
def q_ingest_roundtrip(spark, sf_dir):
    """Ingest reports into four fresh tables, then every row of each."""
    return _loaded(spark, sf_dir, 1)


@register("ingest_skip_seen")
def q_ingest_skip_seen(spark, sf_dir):
    """Report files loaded twice with ``skip_seen``: the second load adds nothing."""
    return _loaded(spark, sf_dir, 2, skip_seen=True)


@register("load_atomic")
def q_load_atomic(spark, sf_dir):
    """Report files loaded as one commit, twice, next to a load that died before its commit: the tables' content."""
    from scanhouse.plans import atomic_load as al

    src, root = _json_files(fx.reports(spark, sf_dir), scratch_dir(spark, "reports-files")), scratch_dir(spark, "loaded")
    files = partial(read_reports, spark, src, layout="lines", with_source=True)
    staged, staging = al.stage_reports(files())
    al.write_tables(staged, root, "died")
    delete_folder(spark, staging)
    for _ in range(2):
        al.load_reports(spark, files, root)
    delete_folder(spark, src)
    return _finished(_content({t: al.read_loaded(spark, root, t) for t in al.FLATTENERS}), [root], packed=True)


@register("load_giant_report")
def q_load_giant_report(spark, sf_dir):
    """All reports merged into one document, in one file that many tasks read, loaded as one commit: the findings."""
    from scanhouse.plans import atomic_load as al

    pieces, src, root = (scratch_dir(spark, x) for x in ("giant-pieces", "giant-report", "loaded"))
    results = F.to_json(F.struct("results"))
    inner = F.expr("substring(r, 13, length(r) - 14)")  # what stands between {"results":[ and ]}
    with shuffles_dropped(spark):
        texts = fx.reports(spark, sf_dir).where(F.size("results") > 0).select(results.alias("r")).select(F.concat(inner, F.lit(",")).alias("value"))
        texts.write.options(**PACKED).text(pieces)

    def document(batches):
        """The pieces as they come, between the document's first and last line: one file has one writer,
        which holds a batch at a time."""
        yield pa.RecordBatch.from_pydict({"value": ['{"version": "1.0", "results": [']})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": ['{"check_id": "last"}]}']})

    spark.read.text(pieces).coalesce(1).mapInArrow(document, "value string").write.text(src)
    delete_folder(spark, pieces)
    al.load_giant_report(spark, src, root)
    delete_folder(spark, src)
    found = al.read_loaded(spark, root, "scan_results").where("check_id <> 'last'")
    return _finished(_flat_text(found), [root], packed=True)


@register("load_stream_and_batch")
def q_load_stream_and_batch(spark, sf_dir):
    """Half of the report files loaded by a batch job, all by a stream, all by a batch job and by a
    stream that knows of no file: the tables' content, compacted."""
    from scanhouse.plans import atomic_load as al
    from scanhouse.sources.commits import sweep
    from scanhouse.streaming.ingest import report_stream

    src, root, *ckpts = (scratch_dir(spark, x) for x in ("reports-files", "loaded", "load-ckpt", "load-ckpt"))
    halves = fx.reports(spark, sf_dir).withColumn("half", F.pmod("report_id", F.lit(2)))
    _json_files(halves, src, "half")
    stream = report_stream(spark, f"{src}/half=*", layout="lines", max_files_per_trigger=8)
    al.load_reports(spark, partial(read_reports, spark, f"{src}/half=0", layout="lines", with_source=True), root)
    al.start_load(spark, stream, root, ckpts[0]).awaitTermination()
    al.load_reports(spark, partial(read_reports, spark, f"{src}/half=*", layout="lines", with_source=True), root)
    al.start_load(spark, stream, root, ckpts[1]).awaitTermination()
    delete_folder(spark, src)
    al.compact(spark, root)
    sweep(spark, root, list(al.LOAD_TABLES), older_than_ms=0)  # nobody else loads into this folder
    return _finished(_content({t: al.read_loaded(spark, root, t) for t in al.FLATTENERS}), [root, *ckpts], packed=True)


def _on_clustered(spark, sf_dir, report) -> DataFrame:
    """A report on findings that were written clustered and read back."""
    from scanhouse.sources.clustered import write_clustered

    path = scratch_dir(spark, "clustered")
    write_clustered(fx.findings(spark, sf_dir).drop("report_id"), path)
    return _finished(report(spark.read.parquet(path)), [path])


@register("explain_check_clustered")
def q_explain_check_clustered(spark, sf_dir):
    return _on_clustered(spark, sf_dir, lambda f: fo.explain_check_flat(f, check_id="rule.7"))


@register("findings_by_cwe_clustered")
def q_findings_by_cwe_clustered(spark, sf_dir):
    return _on_clustered(spark, sf_dir, lambda f: fo.findings_by_cwe(f, cwe_id="CWE-107"))


@register("fix_context_clustered")
def q_fix_context_clustered(spark, sf_dir):
    return _on_clustered(spark, sf_dir, lambda f: fo.fix_context(f, check_id="rule.7"))


# ---------------------------------------------------------------- free SQL and catalog

SQL_TEXTS = {
    "sql_passthrough": (
        "SELECT severity, COUNT(*) AS n FROM findings WHERE security_severity = :level GROUP BY severity",
        {"level": "High"},
    ),
    "sql_join": (
        """SELECT o.o_orderpriority, COUNT(*) AS n_lines, SUM(l.l_quantity) AS qty
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
           GROUP BY o.o_orderpriority""",
        None,
    ),
    "sql_anti_join": (
        """SELECT o_orderkey, o_orderstatus FROM orders o
           WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""",
        None,
    ),
    "sql_set_ops": (
        """SELECT 'both' AS side, n FROM (SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier)
           UNION ALL
           SELECT 'customer_only' AS side, n FROM (SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier)
           UNION ALL
           SELECT 'either' AS side, n FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier)""",
        None,
    ),
    "sql_rollup": (
        """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty
           FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)""",
        None,
    ),
    "sql_window": (
        """SELECT o_custkey, o_orderkey,
             rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rnk,
             ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                     ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving_total
           FROM orders""",
        None,
    ),
    "sql_json": (
        """SELECT event_type, COUNT(*) AS n,
             SUM(CAST(get_json_object(props, '$.k') AS BIGINT)) AS sum_k
           FROM events GROUP BY event_type""",
        None,
    ),
}


def _sql_query(key: str) -> Query:
    text, args = SQL_TEXTS[key]

    def run(spark, sf_dir):
        from scanhouse.operators.sqlops import run_sql

        fx.register_views(spark, sf_dir)
        return run_sql(spark, text, args)

    run.__name__ = f"q_{key}"
    return run


for _key in SQL_TEXTS:
    register(_key)(_sql_query(_key))


@register("as_records")
def q_as_records(spark, sf_dir):
    from scanhouse.operators.sqlops import as_records

    return as_records(fo.severity_counts(fx.findings(spark, sf_dir)))


@register("as_records_nulls")
def q_as_records_nulls(spark, sf_dir):
    """A NULL stays a field of its record."""
    from scanhouse.operators.sqlops import as_records

    return as_records(fo.cwe_summary(fx.findings(spark, sf_dir)))


@register("catalog_inventory")
def q_catalog_inventory(spark, sf_dir):
    from scanhouse.operators.sqlops import catalog_inventory

    db = fx.register_catalog(spark, sf_dir)
    return catalog_inventory(spark, [db]).withColumn("database", F.regexp_replace("database", "_[0-9a-f]{8}$", ""))


@register("schema_profile")
def q_schema_profile(spark, sf_dir):
    from scanhouse.operators.sqlops import schema_profile

    return schema_profile(fx.table(spark, sf_dir, "lineitem"))


# ---------------------------------------------------------------- retrieval

RETRIEVAL_DIM = 256


def _cores(spark) -> int:
    """The driver tables are stored in fewer splits than there are cores."""
    return spark.sparkContext.defaultParallelism


def _api_docs(spark, sf_dir):
    """API-doc catalogue stand-in: every document, ``api = '/' || source``."""
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("content"), F.concat(F.lit("/"), F.col("source")).alias("api"))


def _built_index(spark, docs):
    """Index over the API docs, written once to the shared scratch folder; its path."""
    from scanhouse.sources.docs import build_index, write_index

    path = scratch_dir(spark, "vector-index")
    write_index(build_index(docs, dim=RETRIEVAL_DIM, partitions=_cores(spark)), path)
    return path


def _index_rows(spark, path) -> DataFrame:
    """An index's documents with their content's hash and how many buckets they fill."""
    from scanhouse.sources.docs import read_index

    filled = F.size(F.filter("vector", lambda x: x != 0)).alias("nnz")
    return read_index(spark, path).select("doc_id", "api", F.md5("content").alias("content_md5"), filled)


def _benchmark_docs(spark, sf_dir):
    return fx.table(spark, sf_dir, "benchmark").select(
        (-(F.col("item_id") + 1)).alias("doc_id"), F.col("text").alias("content"), F.lit("/benchmark").alias("api")
    )


@register("embed_terms")
def q_embed_terms(spark, sf_dir):
    from scanhouse.operators.retrieval import term_counts

    docs = fx.table(spark, sf_dir, "documents")
    return term_counts(docs, "doc_id", "text", RETRIEVAL_DIM, partitions=_cores(spark))


@register("embed_dense")
def q_embed_dense(spark, sf_dir):
    from scanhouse.operators.retrieval import embed

    docs = embed(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", RETRIEVAL_DIM, partitions=_cores(spark))
    return docs.select("doc_id", F.posexplode("vector").alias("bucket", "weight")).where(F.col("weight") != 0)


@register("similarity_search")
def q_similarity_search(spark, sf_dir):
    """Every embedding's 3 nearest embeddings (itself included), exact."""
    from scanhouse.operators.retrieval import similarity_search

    e = fx.table(spark, sf_dir, "embeddings")
    return similarity_search(
        e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")),
        k=3,
    ).withColumn("rank", F.col("rank").cast("long"))


def _two_lengths(spark, sf_dir) -> DataFrame:
    """The embeddings, every third of them cut to its first half, as from a second model."""
    half = F.expr("slice(embedding, 1, cast(size(embedding) / 2 as int))")
    e = fx.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.when(F.pmod("vec_id", F.lit(3)) == 0, half).otherwise(F.col("embedding")).alias("vector"))


@register("similarity_search_lengths")
def q_similarity_search_lengths(spark, sf_dir):
    """Vectors of two lengths: every one's 2 nearest of its own length."""
    from scanhouse.operators.retrieval import similarity_search

    e = _two_lengths(spark, sf_dir)
    found = similarity_search(e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "doc_id"), k=2)
    return found.withColumn("rank", F.col("rank").cast("long"))


@register("search_stored_index")
def q_search_stored_index(spark, sf_dir):
    """An index of half of the vectors, stored by cells, the rest added; every vector's 2 nearest of its own length."""
    from scanhouse.operators.stored_index import add_to_stored_index, build_stored_index, search_stored

    root = scratch_dir(spark, "stored-index")
    e = _two_lengths(spark, sf_dir)
    rows = e.withColumnRenamed("vec_id", "doc_id")
    build_stored_index(rows.where("doc_id % 2 = 0"), root, cell_rows=512)
    add_to_stored_index(rows.where("doc_id % 2 <> 0"), root, cell_rows=512)
    found = search_stored(e.withColumnRenamed("vec_id", "query_id"), root, k=2)
    return _finished(found.withColumn("rank", F.col("rank").cast("long")), [root])


@register("route_queries")
def q_route_queries(spark, sf_dir):
    """Route every benchmark question to the API of its nearest document."""
    from scanhouse.operators.retrieval import embed, route
    from scanhouse.sources.docs import read_index

    path = _built_index(spark, _api_docs(spark, sf_dir))
    index = read_index(spark, path)
    qs = embed(fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text", RETRIEVAL_DIM)
    out = route(qs, index).withColumn("required_fields", F.array_join("required_fields", ","))
    return _finished(out, [path])


@register("read_api_docs")
def q_read_api_docs(spark, sf_dir):
    from scanhouse.sources.docs import read_api_docs

    path = scratch_dir(spark, "api-docs")
    _api_docs(spark, sf_dir).select("doc_id", "content", "api").write.json(path)
    docs = read_api_docs(spark, path)
    return _finished(docs.withColumn("required_fields", F.array_join("required_fields", ",")), [path])


@register("index_roundtrip")
def q_index_roundtrip(spark, sf_dir):
    """Every stored vector value, read back."""
    from scanhouse.sources.docs import read_index

    path = _built_index(spark, _api_docs(spark, sf_dir))
    values = read_index(spark, path).select("doc_id", "api", F.posexplode("vector").alias("bucket", "weight"))
    return _finished(values.where(F.col("weight") != 0), [path])


@register("index_append")
def q_index_append(spark, sf_dir):
    """Build the index, append the benchmark items as documents; every document of it."""
    from scanhouse.sources.docs import add_documents

    path = _built_index(spark, _api_docs(spark, sf_dir))
    add_documents(spark, path, _benchmark_docs(spark, sf_dir), dim=RETRIEVAL_DIM)
    return _finished(_index_rows(spark, path), [path])


@register("index_mixed_load")
def q_index_mixed_load(spark, sf_dir):
    """An index built first and then loaded by a stream, and one the other way round."""
    from scanhouse.sources.docs import add_documents
    from scanhouse.streaming.index_load import start_index_load

    src, streamed = (scratch_dir(spark, x) for x in ("docs-src", "docs-index"))
    _benchmark_docs(spark, sf_dir).write.json(src)
    built = _built_index(spark, _api_docs(spark, sf_dir))
    for path in (built, streamed):
        start_index_load(spark, src, path, scratch_dir(spark, "docs-ckpt"), dim=RETRIEVAL_DIM).awaitTermination()
    add_documents(spark, streamed, _api_docs(spark, sf_dir), dim=RETRIEVAL_DIM, partitions=_cores(spark))
    rows = [_index_rows(spark, p).withColumn("first", F.lit(n)) for p, n in ((built, "build"), (streamed, "stream"))]
    return _finished(rows[0].unionByName(rows[1]), [src, built, streamed])


# ---------------------------------------------------------------- conversations and replies

SYSTEM_PROMPT = "You are an assistant that answers questions about code-scan findings with the available tools."


def _history(spark, sf_dir):
    from scanhouse.operators.dialog import history_window

    return history_window(fx.table(spark, sf_dir, "conversations"), k=1)


@register("history_window")
def q_history_window(spark, sf_dir):
    return _history(spark, sf_dir)


def _messages(spark, sf_dir):
    from scanhouse.operators.dialog import build_messages

    h = _history(spark, sf_dir).withColumn("system", F.lit(SYSTEM_PROMPT))
    return build_messages(h, "system").select("conv_id", "turn", "messages")


@register("build_messages")
def q_build_messages(spark, sf_dir):
    """The message lists as text, roles and lengths included, in one row per message list."""
    sizes = F.transform("messages", lambda m: F.concat_ws(":", m["role"], F.length(m["content"]).cast("string"), F.md5(m["content"])))
    return _messages(spark, sf_dir).select("conv_id", "turn", F.array_join(sizes, " ").alias("messages"))


@register("build_messages_json")
def q_build_messages_json(spark, sf_dir):
    """The message lists as JSON text (what is sent to a chat endpoint), NULL contents kept."""
    lists = F.to_json("messages", {"ignoreNullFields": "false"})
    return _messages(spark, sf_dir).select("conv_id", "turn", lists.alias("messages"))


@register("build_messages_flat")
def q_build_messages_flat(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return m.select("conv_id", "turn", F.posexplode("messages").alias("pos", "m")).select(
        "conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


@register("repair_prompt")
def q_repair_prompt(spark, sf_dir):
    from scanhouse.operators.dialog import repair_prompt

    r = fx.responses(spark, sf_dir).where(F.col("status") == 422)
    r = r.withColumn("api", F.concat(F.lit("/"), F.col("event_type")))
    return repair_prompt(r, "api", "body").select("event_id", "system_prompt")


@register("parse_reply")
def q_parse_reply(spark, sf_dir):
    from scanhouse.operators.dialog import parse_reply

    p = parse_reply(spread(fx.replies(spark, sf_dir), _cores(spark)), "body")
    return p.select(
        "event_id",
        "kind",
        "api",
        F.try_element_at("params", F.lit("k")).alias("param_k"),
        F.when(F.col("params").isNotNull(), F.size("params")).alias("n_params"),
        F.array_join("missing", ",").alias("missing"),
        "message",
        "raw",
    )


@register("classify_response")
def q_classify_response(spark, sf_dir):
    from scanhouse.operators.dialog import classify_response

    return classify_response(fx.responses(spark, sf_dir)).select("event_id", "status", "kind", "message")


@register("classify_response_strict")
def q_classify_response_strict(spark, sf_dir):
    from scanhouse.operators.dialog import classify_response

    return classify_response(fx.responses(spark, sf_dir), require_missing=True).select("event_id", "status", "kind")


@register("missing_fields")
def q_missing_fields(spark, sf_dir):
    from scanhouse.operators.dialog import missing_fields

    r = fx.responses(spark, sf_dir)
    return r.select("event_id", F.array_join(missing_fields(F.col("body")), ",").alias("missing"))


@register("blank_required")
def q_blank_required(spark, sf_dir):
    from scanhouse.operators.dialog import blank_required

    ev = fx.table(spark, sf_dir, "events")
    payload = F.from_json("props", "map<string,string>")
    blank = blank_required(F.array(F.lit("k"), F.lit("z")), payload)
    return ev.select("event_id", F.array_join(blank, ",").alias("blank"))


@register("merge_payload")
def q_merge_payload(spark, sf_dir):
    from scanhouse.operators.dialog import merge_payload

    ev = fx.table(spark, sf_dir, "events")
    extra = F.create_map(F.lit("table"), F.lit("scan_results"), F.lit("k"), F.col("user_id").cast("string"))
    merged = merge_payload(F.from_json("props", "map<string,string>"), extra)
    return ev.select("event_id", F.explode(merged).alias("key", "value"))


# ---------------------------------------------------------------- streaming load


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """Reports dropped as JSON files, loaded by an availableNow stream into catalog tables: their content."""
    from scanhouse.plans.ingest import FLATTENERS
    from scanhouse.streaming.ingest import start_ingest

    src, out, ckpt = (scratch_dir(spark, x) for x in ("stream-src", "stream-out", "stream-ckpt"))
    db = f"scanhouse_{uuid.uuid4().hex[:12]}"
    _json_files(fx.reports(spark, sf_dir), src)
    start_ingest(spark, src, out, ckpt, layout="lines", max_files_per_trigger=4, db=db).awaitTermination()
    tables = {name: spark.table(f"{db}.{name}").drop("batch_id") for name in FLATTENERS}
    delete_folder(spark, src)
    return _finished(_content(tables), [out, ckpt], [db], packed=True)


@register("stream_index_load")
def q_stream_index_load(spark, sf_dir):
    """API-doc files dropped in a folder, embedded into the index by an availableNow stream."""
    from scanhouse.streaming.index_load import start_index_load

    src, index_path, ckpt = (scratch_dir(spark, x) for x in ("docs-src", "docs-index", "docs-ckpt"))
    _api_docs(spark, sf_dir).write.json(src)
    start_index_load(spark, src, index_path, ckpt, dim=RETRIEVAL_DIM, max_files_per_trigger=8).awaitTermination()
    return _finished(_index_rows(spark, index_path), [src, index_path, ckpt])
