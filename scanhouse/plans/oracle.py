"""DuckDB SQL oracles for the registered queries (one text per ``queries()`` key).

They run on the driver's views of the parquet tables and restate each derivation
independently of the Spark code, so a match checks the Spark plan, not itself.
Where the Spark plan is clever (tiled nearest-neighbour search), the oracle is the
plain brute force (all pairs, then rank) — affordable only at check scale.
"""

from __future__ import annotations

FINDINGS_CTE = """
findings AS (
  SELECT l_orderkey AS report_id,
    concat('rule.', CAST(l_partkey % 100 AS VARCHAR)) AS check_id,
    concat('src/', CAST(l_suppkey AS VARCHAR), '.c') AS path,
    CAST(l_linenumber AS BIGINT) AS start_line,
    CAST(l_quantity AS BIGINT) AS start_col,
    l_partkey AS start_offset,
    CAST(l_linenumber + 1 AS BIGINT) AS end_line,
    CAST(l_quantity AS BIGINT) + 5 AS end_col,
    l_partkey + 40 AS end_offset,
    concat('message for rule ', CAST(l_partkey % 100 AS VARCHAR)) AS message,
    CASE l_returnflag WHEN 'A' THEN 'ERROR' WHEN 'R' THEN 'WARNING' ELSE 'INFO' END AS severity,
    concat('fp-', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS fingerprint,
    CASE WHEN l_discount >= CAST(0.03 AS DOUBLE) THEN 'security' ELSE 'best-practice' END AS category,
    CASE WHEN l_partkey % 25 = 0 THEN NULL
         ELSE concat('CWE-', CAST(100 + l_partkey % 25 AS VARCHAR)) END AS cwe,
    CASE WHEN l_tax >= CAST(0.05 AS DOUBLE) THEN ['A03:2021', 'A01:2021'] ELSE CAST([] AS VARCHAR[]) END AS owasp,
    CASE WHEN l_discount >= CAST(0.07 AS DOUBLE) THEN 'High'
         WHEN l_discount >= CAST(0.03 AS DOUBLE) THEN 'Medium' ELSE 'Low' END AS security_severity,
    CASE WHEN l_linestatus = 'O' THEN concat('short ', CAST(l_partkey % 100 AS VARCHAR)) END AS shortDescription,
    'OSS' AS engine_kind,
    CASE WHEN l_tax < CAST(0.02 AS DOUBLE) THEN 'NO_VALIDATOR' END AS validation_state,
    concat('line ', CAST(l_linenumber AS VARCHAR)) AS lines
  FROM lineitem
)"""

# findings that belong to a report (an order); the nested reports are built from these
REPORTED_CTE = (
    FINDINGS_CTE
    + """,
reported AS (
  SELECT f.* FROM findings f JOIN orders o ON o.o_orderkey = f.report_id
)"""
)


def with_findings(body: str) -> str:
    return "WITH " + FINDINGS_CTE + "\n" + body


def with_reported(body: str) -> str:
    return "WITH " + REPORTED_CTE + "\n" + body


FLAT_RESULTS_SELECT = """
SELECT check_id, path, start_line, start_col, start_offset, end_line, end_col, end_offset,
  message, severity, fingerprint, category, cwe, array_to_string(owasp, ',') AS owasp,
  security_severity, shortDescription, engine_kind, validation_state, lines
FROM reported
"""



def row_text(columns: str, arrays: list[str] = ()) -> str:
    """A row's columns as one text, NULLs as ``~``."""
    cells = [f"array_to_string({c}, ',')" if c in arrays else f"CAST({c} AS VARCHAR)" for c in columns.split()]
    return "concat_ws('|', " + ", ".join(f"coalesce({c}, '~')" for c in cells) + ")"


ORACLE: dict[str, str] = {
    "high_severity_files": with_findings(
        """
SELECT path, COUNT(*) AS high_count FROM findings
WHERE security_severity = 'High'
GROUP BY path ORDER BY high_count DESC, path LIMIT 50"""
    ),
    "severity_counts": with_findings(
        "SELECT severity, COUNT(*) AS count FROM findings GROUP BY severity ORDER BY count DESC"
    ),
    "vulnerability_summary": with_findings(
        """
SELECT severity, COUNT(*) AS count, (SELECT COUNT(*) FROM findings) AS total
FROM findings GROUP BY severity"""
    ),
    "high_severity_headline": with_findings(
        """,
top AS (
  SELECT path, COUNT(*) AS high_count FROM findings WHERE security_severity = 'High'
  GROUP BY path ORDER BY high_count DESC, path LIMIT 50
)
SELECT CASE WHEN COUNT(*) = 0 THEN 'There are no files with high-severity vulnerabilities.'
  ELSE 'There are ' || CAST(COUNT(*) AS VARCHAR) || ' files with high-severity vulnerabilities. '
       || 'The file with the most issues is ''' || arg_min(path, (-high_count, path)) || '''.' END AS summary
FROM top"""
    ),
    "cwe_summary": with_findings("SELECT cwe, COUNT(*) AS cnt FROM findings GROUP BY cwe ORDER BY cnt DESC"),
    "explain_check_flat": with_findings(
        """,
msg AS (
  SELECT check_id, message FROM (
    SELECT check_id, message, row_number() OVER (PARTITION BY check_id
      ORDER BY path, start_line, start_col, end_line, end_col, start_offset, end_offset, message) AS rn
    FROM findings) WHERE rn = 1
)
SELECT f.check_id, m.message, f.path, f.start_line, f.start_col, f.end_line, f.end_col
FROM findings f JOIN msg m ON f.check_id = m.check_id"""
    ),
    "explain_check": with_findings(
        """,
msg AS (
  SELECT check_id, message FROM (
    SELECT check_id, message, row_number() OVER (PARTITION BY check_id
      ORDER BY path, start_line, start_col, end_line, end_col, start_offset, end_offset, message) AS rn
    FROM findings) WHERE rn = 1
)
SELECT f.check_id, m.message, CAST(0 AS BIGINT) AS page,
  CAST(to_json(list({'path': f.path, 'start_line': f.start_line, 'start_col': f.start_col,
                     'end_line': f.end_line, 'end_col': f.end_col}
                    ORDER BY f.path, f.start_line, f.start_col, f.end_line, f.end_col)) AS VARCHAR) AS occurrences
FROM findings f JOIN msg m ON f.check_id = m.check_id
GROUP BY f.check_id, m.message"""
    ),
    "explain_check_one": with_findings(
        """,
scoped AS (SELECT * FROM findings WHERE check_id = 'rule.7'),
msg AS (
  SELECT check_id, message FROM (
    SELECT check_id, message, row_number() OVER (PARTITION BY check_id
      ORDER BY path, start_line, start_col, end_line, end_col, start_offset, end_offset, message) AS rn
    FROM scoped) WHERE rn = 1
)
SELECT ids.id AS check_id, coalesce(x.rule_message, 'No information found for this check_id.') AS message,
  x.path, x.start_line, x.start_col, x.end_line, x.end_col
FROM (SELECT 'rule.7' AS id) ids
LEFT JOIN (SELECT f.*, m.message AS rule_message FROM scoped f JOIN msg m ON f.check_id = m.check_id) x
  ON x.check_id = ids.id"""
    ),
    "explain_check_absent": with_findings(
        """
SELECT 'rule.absent' AS check_id,
  coalesce(max(message), 'No information found for this check_id.') AS message,
  CAST(NULL AS VARCHAR) AS path, CAST(NULL AS BIGINT) AS start_line, CAST(NULL AS BIGINT) AS start_col,
  CAST(NULL AS BIGINT) AS end_line, CAST(NULL AS BIGINT) AS end_col
FROM findings WHERE check_id = 'rule.absent'"""
    ),
    "findings_by_cwe": with_findings(
        """,
per_file AS (SELECT cwe, path, COUNT(*) AS count FROM findings GROUP BY cwe, path)
SELECT cwe, path, count, CAST(SUM(count) OVER (PARTITION BY cwe) AS BIGINT) AS total_count FROM per_file"""
    ),
    "findings_by_cwe_one": with_findings(
        """,
per_file AS (SELECT cwe, path, COUNT(*) AS count FROM findings WHERE cwe = 'CWE-107' GROUP BY cwe, path)
SELECT cwe, path, count, CAST(SUM(count) OVER (PARTITION BY cwe) AS BIGINT) AS total_count FROM per_file"""
    ),
    "findings_by_cwe_absent": "SELECT 'CWE-0' AS cwe, CAST(NULL AS VARCHAR) AS path, CAST(0 AS BIGINT) AS count, CAST(0 AS BIGINT) AS total_count",
    "findings_by_cwe_nested": with_findings(
        """,
per_file AS (SELECT cwe, path, COUNT(*) AS count FROM findings GROUP BY cwe, path)
SELECT cwe, CAST(SUM(count) AS BIGINT) AS total_count, CAST(0 AS BIGINT) AS page,
  CAST(to_json(list({'path': path, 'count': count} ORDER BY path, count)) AS VARCHAR) AS files
FROM per_file GROUP BY cwe"""
    ),
    "fix_context": with_findings(
        """
SELECT check_id, shortDescription, message FROM (
  SELECT check_id, shortDescription, message, row_number() OVER (PARTITION BY check_id
    ORDER BY path, start_line, start_col, end_line, end_col, start_offset, end_offset,
             shortDescription NULLS FIRST, message) AS rn
  FROM findings) WHERE rn = 1"""
    ),
    "fix_context_one": with_findings(
        """
SELECT 'rule.7' AS check_id,
  CASE WHEN COUNT(*) = 0 THEN '' ELSE max(shortDescription) FILTER (WHERE rn = 1) END AS shortDescription,
  CASE WHEN COUNT(*) = 0 THEN 'Not found' ELSE max(message) FILTER (WHERE rn = 1) END AS message
FROM (
  SELECT shortDescription, message, row_number() OVER (
    ORDER BY path, start_line, start_col, end_line, end_col, start_offset, end_offset,
             shortDescription NULLS FIRST, message) AS rn
  FROM findings WHERE check_id = 'rule.7')"""
    ),
    "flatten_results": with_reported(FLAT_RESULTS_SELECT),
    "read_reports": with_reported(FLAT_RESULTS_SELECT),
    "read_reports_multiline": with_reported(FLAT_RESULTS_SELECT),
    "flatten_errors": with_reported(
        """
SELECT start_offset % 5 AS code, CASE WHEN start_col > 25 THEN 'warn' ELSE 'error' END AS level,
  message, path
FROM reported WHERE severity = 'ERROR'"""
    ),
    "flatten_error_spans": with_reported(
        """
SELECT start_offset % 5 AS code, path AS file, start_line, start_col, start_offset,
  end_line, end_col, end_offset
FROM reported WHERE severity = 'ERROR' AND start_col % 2 = 1"""
    ),
    "report_summary": with_findings(
        """
SELECT o.o_orderpriority AS version,
  coalesce(array_to_string(list_sort(list(DISTINCT f.path) FILTER (WHERE f.path IS NOT NULL)), ','), '') AS scanned,
  coalesce(array_to_string(list_sort(list(DISTINCT f.check_id) FILTER (WHERE f.severity = 'INFO')), ','), '') AS skipped_rules
FROM orders o LEFT JOIN findings f ON o.o_orderkey = f.report_id
GROUP BY o.o_orderkey, o.o_orderpriority"""
    ),
    "ingest_roundtrip": with_reported(
        f"""
SELECT 'scan_results' AS table_name, {row_text("check_id path start_line start_col start_offset end_line end_col end_offset message severity fingerprint category cwe owasp security_severity shortDescription engine_kind validation_state lines", ["owasp"])} AS row FROM reported
UNION ALL SELECT 'scan_error_spans', {row_text("start_offset%5 path start_line start_col start_offset end_line end_col end_offset")}
  FROM reported WHERE severity = 'ERROR' AND start_col % 2 = 1
UNION ALL SELECT 'scan_errors', concat_ws('|', CAST(start_offset % 5 AS VARCHAR), CASE WHEN start_col > 25 THEN 'warn' ELSE 'error' END, message, path)
  FROM reported WHERE severity = 'ERROR'
UNION ALL SELECT 'scan_summary', concat_ws('|', o.o_orderpriority,
    coalesce(array_to_string(list_sort(list(DISTINCT f.path) FILTER (WHERE f.path IS NOT NULL)), ','), ''),
    coalesce(array_to_string(list_sort(list(DISTINCT f.check_id) FILTER (WHERE f.severity = 'INFO')), ','), ''))
  FROM orders o LEFT JOIN findings f ON o.o_orderkey = f.report_id GROUP BY o.o_orderkey, o.o_orderpriority"""
    ),
}

SQL_ORACLE: dict[str, str] = {
    "sql_passthrough": with_findings(
        "SELECT severity, COUNT(*) AS n FROM findings WHERE security_severity = 'High' GROUP BY severity"
    ),
    "sql_join": """
SELECT o.o_orderpriority, COUNT(*) AS n_lines, SUM(l.l_quantity) AS qty
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderpriority""",
    "sql_anti_join": """
SELECT o_orderkey, o_orderstatus FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""",
    "sql_set_ops": """
SELECT 'both' AS side, n FROM (SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL
SELECT 'customer_only' AS side, n FROM (SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL
SELECT 'either' AS side, n FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier)""",
    "sql_rollup": """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty
FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)""",
    "sql_window": """
SELECT o_custkey, o_orderkey,
  CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rnk,
  ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                          ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving_total
FROM orders""",
    "sql_json": """
SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k
FROM events GROUP BY event_type""",
    "as_records": with_findings(
        """
SELECT CAST(to_json({'severity': severity, 'count': count}) AS VARCHAR) AS record
FROM (SELECT severity, COUNT(*) AS count FROM findings GROUP BY severity)"""
    ),
    "as_records_nulls": with_findings(
        """
SELECT CAST(to_json({'cwe': cwe, 'cnt': cnt}) AS VARCHAR) AS record
FROM (SELECT cwe, COUNT(*) AS cnt FROM findings GROUP BY cwe)"""
    ),
    "catalog_inventory": """
SELECT 'driver_tables' AS database, 'region' AS "table",
  CAST((SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'region') AS INTEGER) AS n_columns,
  COUNT(*) AS n_rows FROM region
UNION ALL
SELECT 'driver_tables' AS database, 'nation' AS "table",
  CAST((SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'nation') AS INTEGER) AS n_columns,
  COUNT(*) AS n_rows FROM nation
UNION ALL
SELECT 'driver_tables' AS database, 'customer' AS "table",
  CAST((SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'customer') AS INTEGER) AS n_columns,
  COUNT(*) AS n_rows FROM customer
UNION ALL
SELECT 'driver_tables' AS database, 'supplier' AS "table",
  CAST((SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'supplier') AS INTEGER) AS n_columns,
  COUNT(*) AS n_rows FROM supplier
UNION ALL
SELECT 'driver_tables' AS database, 'part' AS "table",
  CAST((SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'part') AS INTEGER) AS n_columns,
  COUNT(*) AS n_rows FROM part
UNION ALL
SELECT 'driver_tables' AS database, 'orders' AS "table",
  CAST((SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'orders') AS INTEGER) AS n_columns,
  COUNT(*) AS n_rows FROM orders
UNION ALL
SELECT 'driver_tables' AS database, 'lineitem' AS "table",
  CAST((SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'lineitem') AS INTEGER) AS n_columns,
  COUNT(*) AS n_rows FROM lineitem
UNION ALL
SELECT 'driver_tables' AS database, 'events' AS "table",
  CAST((SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'events') AS INTEGER) AS n_columns,
  COUNT(*) AS n_rows FROM events
UNION ALL
SELECT 'driver_tables' AS database, 'documents' AS "table",
  CAST((SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'documents') AS INTEGER) AS n_columns,
  COUNT(*) AS n_rows FROM documents
UNION ALL
SELECT 'driver_tables' AS database, 'embeddings' AS "table",
  CAST((SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'embeddings') AS INTEGER) AS n_columns,
  COUNT(*) AS n_rows FROM embeddings
UNION ALL
SELECT 'driver_tables' AS database, 'pages' AS "table",
  CAST((SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'pages') AS INTEGER) AS n_columns,
  COUNT(*) AS n_rows FROM pages
UNION ALL
SELECT 'driver_tables' AS database, 'benchmark' AS "table",
  CAST((SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'benchmark') AS INTEGER) AS n_columns,
  COUNT(*) AS n_rows FROM benchmark
UNION ALL
SELECT 'driver_tables' AS database, 'labels' AS "table",
  CAST((SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'labels') AS INTEGER) AS n_columns,
  COUNT(*) AS n_rows FROM labels
UNION ALL
SELECT 'driver_tables' AS database, 'conversations' AS "table",
  CAST((SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'conversations') AS INTEGER) AS n_columns,
  COUNT(*) AS n_rows FROM conversations""",
    # parquet timestamps without UTC adjustment (DuckDB TIMESTAMP) are Spark timestamp_ntz
    "schema_profile": """
SELECT 'l_orderkey' AS "column", 'bigint' AS type, TRUE AS nullable, COUNT(*) AS n_rows, COUNT(*) - COUNT(l_orderkey) AS n_null, COUNT(DISTINCT l_orderkey) AS n_distinct FROM lineitem
UNION ALL
SELECT 'l_partkey' AS "column", 'bigint' AS type, TRUE AS nullable, COUNT(*) AS n_rows, COUNT(*) - COUNT(l_partkey) AS n_null, COUNT(DISTINCT l_partkey) AS n_distinct FROM lineitem
UNION ALL
SELECT 'l_suppkey' AS "column", 'bigint' AS type, TRUE AS nullable, COUNT(*) AS n_rows, COUNT(*) - COUNT(l_suppkey) AS n_null, COUNT(DISTINCT l_suppkey) AS n_distinct FROM lineitem
UNION ALL
SELECT 'l_linenumber' AS "column", 'int' AS type, TRUE AS nullable, COUNT(*) AS n_rows, COUNT(*) - COUNT(l_linenumber) AS n_null, COUNT(DISTINCT l_linenumber) AS n_distinct FROM lineitem
UNION ALL
SELECT 'l_quantity' AS "column", 'double' AS type, TRUE AS nullable, COUNT(*) AS n_rows, COUNT(*) - COUNT(l_quantity) AS n_null, COUNT(DISTINCT l_quantity) AS n_distinct FROM lineitem
UNION ALL
SELECT 'l_extendedprice' AS "column", 'double' AS type, TRUE AS nullable, COUNT(*) AS n_rows, COUNT(*) - COUNT(l_extendedprice) AS n_null, COUNT(DISTINCT l_extendedprice) AS n_distinct FROM lineitem
UNION ALL
SELECT 'l_discount' AS "column", 'double' AS type, TRUE AS nullable, COUNT(*) AS n_rows, COUNT(*) - COUNT(l_discount) AS n_null, COUNT(DISTINCT l_discount) AS n_distinct FROM lineitem
UNION ALL
SELECT 'l_tax' AS "column", 'double' AS type, TRUE AS nullable, COUNT(*) AS n_rows, COUNT(*) - COUNT(l_tax) AS n_null, COUNT(DISTINCT l_tax) AS n_distinct FROM lineitem
UNION ALL
SELECT 'l_returnflag' AS "column", 'string' AS type, TRUE AS nullable, COUNT(*) AS n_rows, COUNT(*) - COUNT(l_returnflag) AS n_null, COUNT(DISTINCT l_returnflag) AS n_distinct FROM lineitem
UNION ALL
SELECT 'l_linestatus' AS "column", 'string' AS type, TRUE AS nullable, COUNT(*) AS n_rows, COUNT(*) - COUNT(l_linestatus) AS n_null, COUNT(DISTINCT l_linestatus) AS n_distinct FROM lineitem
UNION ALL
SELECT 'l_shipdate' AS "column", 'timestamp_ntz' AS type, TRUE AS nullable, COUNT(*) AS n_rows, COUNT(*) - COUNT(l_shipdate) AS n_null, COUNT(DISTINCT l_shipdate) AS n_distinct FROM lineitem""",
}

ORACLE.update(SQL_ORACLE)

# ---------------------------------------------------------------- retrieval
# hashed term weights: token = run of letters/digits (lower-cased), bucket = first 32 bits of md5 mod 256


def sparse_weights_cte(name: str, source: str, id_expr: str, text_expr: str, dim: int = 256) -> str:
    return f"""
{name}_tok AS (
  SELECT {id_expr} AS id, unnest(regexp_split_to_array(lower({text_expr}), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {source}
),
{name}_tf AS (
  SELECT id, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {dim} AS INTEGER) AS bucket, COUNT(*) AS tf
  FROM {name}_tok WHERE length(t) > 0 GROUP BY 1, 2
),
{name} AS (
  SELECT id, bucket, tf, tf / sqrt(SUM(tf * tf) OVER (PARTITION BY id)) AS weight FROM {name}_tf
)"""


RETRIEVAL_ORACLE: dict[str, str] = {
    "embed_terms": "WITH "
    + sparse_weights_cte("w", "documents", "doc_id", "text")
    + "\nSELECT id AS doc_id, bucket, tf, weight FROM w",
    "embed_dense": "WITH "
    + sparse_weights_cte("w", "documents", "doc_id", "text")
    + "\nSELECT id AS doc_id, bucket, CAST(weight AS FLOAT) AS weight FROM w",
    "similarity_search": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS distance
  FROM e a CROSS JOIN e b
)
SELECT query_id, rank, doc_id, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM p
) WHERE rank <= 3""",
    "route_queries": "WITH "
    + sparse_weights_cte("qw", "benchmark", "item_id", "text")
    + ","
    + sparse_weights_cte("dw", "documents", "doc_id", "text")
    + """,
qf AS (SELECT id, bucket, CAST(CAST(weight AS FLOAT) AS DOUBLE) AS w FROM qw),
df AS (SELECT id, bucket, CAST(CAST(weight AS FLOAT) AS DOUBLE) AS w FROM dw),
qn AS (SELECT b.item_id AS id, coalesce(SUM(qf.w * qf.w), 0) AS n2 FROM benchmark b LEFT JOIN qf ON qf.id = b.item_id GROUP BY 1),
dn AS (SELECT d.doc_id AS id, coalesce(SUM(df.w * df.w), 0) AS n2 FROM documents d LEFT JOIN df ON df.id = d.doc_id GROUP BY 1),
dot AS (SELECT qf.id AS qid, df.id AS did, SUM(qf.w * df.w) AS dot FROM qf JOIN df ON qf.bucket = df.bucket GROUP BY 1, 2),
p AS (
  SELECT qn.id AS query_id, dn.id AS doc_id,
    greatest(0.0, qn.n2 + dn.n2 - 2 * coalesce(dot.dot, 0)) AS distance
  FROM qn CROSS JOIN dn LEFT JOIN dot ON dot.qid = qn.id AND dot.did = dn.id
),
best AS (
  -- this sum's rounding differs from pair to pair: equal to 12 decimals counts as equal here
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), doc_id) AS rn FROM p) WHERE rn = 1
)
SELECT best.query_id, best.doc_id, '/' || d.source AS api, '' AS required_fields, round(best.distance, 6) AS distance, TRUE AS found
FROM best JOIN documents d ON d.doc_id = best.doc_id""",
    "read_api_docs": "SELECT doc_id, text AS content, '/' || source AS api, '' AS required_fields FROM documents",
    "stream_index_load": "WITH "
    + sparse_weights_cte("w", "documents", "doc_id", "text")
    + """
SELECT d.doc_id, '/' || d.source AS api, md5(d.text) AS content_md5, CAST(COUNT(w.bucket) AS INTEGER) AS nnz
FROM documents d LEFT JOIN w ON w.id = d.doc_id GROUP BY d.doc_id, d.source, d.text""",
    "index_roundtrip": "WITH "
    + sparse_weights_cte("w", "documents", "doc_id", "text")
    + """
SELECT d.doc_id, '/' || d.source AS api, w.bucket, CAST(w.weight AS FLOAT) AS weight
FROM documents d JOIN w ON w.id = d.doc_id""",
    "index_append": "WITH "
    + sparse_weights_cte("w", "documents", "doc_id", "text")
    + ","
    + sparse_weights_cte("b", "benchmark", "-(item_id + 1)", "text")
    + """
SELECT d.doc_id, '/' || d.source AS api, md5(d.text) AS content_md5, CAST(COUNT(w.bucket) AS INTEGER) AS nnz
FROM documents d LEFT JOIN w ON w.id = d.doc_id GROUP BY d.doc_id, d.source, d.text
UNION ALL SELECT -(i.item_id + 1), '/benchmark', md5(i.text), CAST(COUNT(b.bucket) AS INTEGER)
FROM benchmark i LEFT JOIN b ON b.id = -(i.item_id + 1) GROUP BY i.item_id, i.text""",
}
RETRIEVAL_ORACLE["index_mixed_load"] = (
    f"SELECT *, 'build' AS first FROM ({RETRIEVAL_ORACLE['index_append']}) UNION ALL "
    f"SELECT *, 'stream' AS first FROM ({RETRIEVAL_ORACLE['index_append']})"
)

ORACLE.update(RETRIEVAL_ORACLE)

# ---------------------------------------------------------------- conversations and replies


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _dialog_oracle() -> dict[str, str]:
    from scanhouse.operators.dialog import REPAIR_PROMPT_FMT
    from scanhouse.plans.fixtures import DETAIL_422, MISSING_REPLY, ODD_REPLIES, ODD_RESPONSES
    from scanhouse.plans.registry import SYSTEM_PROMPT

    history = """
m AS (
  SELECT conv_id, turn, role, text,
    CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'AI' ELSE role END || ': ' || text AS line
  FROM conversations WHERE role <> 'system'
),
h AS (
  SELECT conv_id, turn, role, text,
    coalesce(array_to_string(list(line) OVER (PARTITION BY conv_id ORDER BY turn
                                              ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), chr(10)), '') AS history
  FROM m
)"""
    def odd(bodies):
        whens = " ".join(f"WHEN {16 * i + 5} THEN {_sql_text(b)}" for i, b in enumerate(bodies))
        return f"CASE event_id % {16 * len(bodies)} {whens} END"

    replies = f"""
r AS (
  SELECT event_id, coalesce({odd(ODD_REPLIES)}, CASE event_type
      WHEN 'error' THEN {_sql_text(MISSING_REPLY)}
      WHEN 'click' THEN '{{"api": "/describe_table", "params": ' || props || '}}'
      WHEN 'view' THEN props
      WHEN 'signup' THEN 'I could not find a tool for event ' || CAST(event_id AS VARCHAR)
      ELSE '{{"api": "/query_table", "params": ' || props END) AS body
  FROM events
),
k AS (
  SELECT event_id, body, json_valid(body) AS ok,
    CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN json_keys(body) END AS keys
  FROM r
),
p AS (
  SELECT event_id, body, CASE WHEN body IS NULL THEN 'empty' WHEN NOT ok THEN 'text'
      WHEN coalesce(list_contains(keys, 'missing_params'), false) THEN 'missing'
      WHEN coalesce(list_contains(keys, 'api') AND list_contains(keys, 'params'), false) THEN 'call'
      ELSE 'unexpected' END AS kind
  FROM k
)"""
    responses = f"""
resp AS (
  SELECT event_id, event_type, props,
    CASE event_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 422 ELSE 500 END AS status
  FROM events
),
rb AS (
  SELECT event_id, event_type, status, coalesce({odd(ODD_RESPONSES)}, CASE
      WHEN status = 200 THEN props
      WHEN status = 500 THEN 'Internal Server Error'
      WHEN event_type = 'signup' THEN 'Unprocessable request'
      WHEN event_type = 'view' THEN '{{"error": "bad input"}}'
      WHEN event_type = 'purchase' THEN '{{"detail": "Not authenticated"}}'
      ELSE {_sql_text(DETAIL_422)} END) AS body
  FROM resp
),
rc AS (
  SELECT *, json_valid(body) AS ok,
    CASE WHEN json_valid(body) AND json_type(body, '$.detail') = 'ARRAY' THEN
      list_transform(list_filter(json_extract(body, '$.detail[*]'), lambda d: json_extract_string(d, '$.type') = 'missing'),
                     lambda d: json_extract_string(d, '$.loc[#-1]'))
    ELSE CAST([] AS VARCHAR[]) END AS missing,
    CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN list_contains(json_keys(body), 'detail') ELSE false END AS has_detail
  FROM rb
)"""
    return {
        "history_window": "WITH " + history + "\nSELECT conv_id, turn, role, text, history FROM h",
        "build_messages_flat": "WITH "
        + history
        + f"""
SELECT conv_id, turn, CAST(0 AS BIGINT) AS pos, 'system' AS role, {_sql_text(SYSTEM_PROMPT)} AS content FROM h
UNION ALL SELECT conv_id, turn, CAST(1 AS BIGINT), 'user', history FROM h WHERE history <> ''
UNION ALL SELECT conv_id, turn, CAST(CASE WHEN history <> '' THEN 2 ELSE 1 END AS BIGINT), 'user', text FROM h""",
        "build_messages": "WITH "
        + history
        + f""",
msgs AS (
  SELECT conv_id, turn, 0 AS pos, 'system' AS role, {_sql_text(SYSTEM_PROMPT)} AS content FROM h
  UNION ALL SELECT conv_id, turn, 1, 'user', history FROM h WHERE history <> ''
  UNION ALL SELECT conv_id, turn, 2, 'user', text FROM h
)
SELECT conv_id, turn, string_agg(role || ':' || length(content) || ':' || md5(content), ' ' ORDER BY pos) AS messages
FROM msgs GROUP BY conv_id, turn""",
        "build_messages_json": "WITH "
        + history
        + f""",
msgs AS (
  SELECT conv_id, turn, 0 AS pos, 'system' AS role, {_sql_text(SYSTEM_PROMPT)} AS content FROM h
  UNION ALL SELECT conv_id, turn, 1, 'user', history FROM h WHERE history <> ''
  UNION ALL SELECT conv_id, turn, CASE WHEN history <> '' THEN 2 ELSE 1 END, 'user', text FROM h
)
SELECT conv_id, turn, CAST(to_json(list({{'role': role, 'content': content}} ORDER BY pos)) AS VARCHAR) AS messages
FROM msgs GROUP BY conv_id, turn""",
        "repair_prompt": "WITH "
        + responses
        + f"""
SELECT event_id, printf({_sql_text(REPAIR_PROMPT_FMT)}, '/' || event_type, body) AS system_prompt
FROM rb WHERE status = 422""",
        "parse_reply": "WITH "
        + replies
        + """
SELECT event_id, kind,
  CASE WHEN kind = 'call' THEN json_extract_string(body, '$.api') END AS api,
  CASE WHEN kind = 'call' THEN json_extract_string(body, '$.params.k') END AS param_k,
  CASE WHEN kind = 'call' THEN CAST(len(json_keys(body, '$.params')) AS INTEGER) END AS n_params,
  CASE WHEN kind = 'missing' AND json_type(body, '$.missing_params') = 'ARRAY'
    THEN array_to_string(json_extract_string(body, '$.missing_params[*]'), ',') END AS missing,
  CASE WHEN kind = 'missing' THEN json_extract_string(body, '$.message') END AS message,
  CASE WHEN kind IN ('missing', 'unexpected') THEN body END AS raw
FROM p""",
        "classify_response": "WITH "
        + responses
        + """
SELECT event_id, status, kind, CASE
    WHEN kind = 'failed' THEN 'API 呼叫失敗: ' || CAST(status AS VARCHAR) || ', ' || coalesce(body, '')
    WHEN kind = 'needs_arguments' THEN coalesce(json_extract_string(body, '$.detail'), 'null')
    ELSE body END AS message
FROM (
  SELECT *, CASE WHEN status = 200 AND ok THEN 'ok'
                 WHEN status = 422 AND ok AND has_detail THEN 'needs_arguments'
                 ELSE 'failed' END AS kind
  FROM rc
)""",
        "classify_response_strict": "WITH "
        + responses
        + """
SELECT event_id, status, CASE WHEN status = 200 AND ok THEN 'ok'
    WHEN status = 422 AND ok AND has_detail AND len(missing) > 0 THEN 'needs_arguments'
    ELSE 'failed' END AS kind
FROM rc""",
        "missing_fields": "WITH " + responses + "\nSELECT event_id, array_to_string(missing, ',') AS missing FROM rc",
        "blank_required": """
SELECT event_id, array_to_string(list_filter(['k', 'z'],
    lambda f: coalesce(trim(json_extract_string(props, '$.' || f)), '') = ''), ',') AS blank
FROM events""",
        "merge_payload": """
WITH base AS (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)
SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM base WHERE key NOT IN ('table', 'k')
UNION ALL SELECT event_id, 'table', 'scan_results' FROM events
UNION ALL SELECT event_id, 'k', CAST(user_id AS VARCHAR) FROM events""",
    }


ORACLE.update(_dialog_oracle())

ORACLE["stream_ingest"] = ORACLE["ingest_roundtrip"]
ORACLE["ingest_skip_seen"] = ORACLE["ingest_roundtrip"]
ORACLE["load_atomic"] = ORACLE["load_stream_and_batch"] = ORACLE["ingest_roundtrip"]
ORACLE["load_giant_report"] = ORACLE["flatten_results"]
ORACLE["explain_check_clustered"] = ORACLE["explain_check_one"]
ORACLE["findings_by_cwe_clustered"] = ORACLE["findings_by_cwe_one"]
ORACLE["fix_context_clustered"] = ORACLE["fix_context_one"]
ORACLE["similarity_search_lengths"] = ORACLE["search_stored_index"] = """
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 0 THEN embedding[1:len(embedding) // 2] ELSE embedding END AS DOUBLE[]) AS v FROM embeddings),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS distance
  FROM e a JOIN e b ON len(a.v) = len(b.v)
)
SELECT query_id, rank, doc_id, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM p
) WHERE rank <= 2"""
