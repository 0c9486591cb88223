"""Fixed schemas: the scan-report document and the four flat report tables.

The report schema is declared, never inferred: inference fails on optional fields
that no finding carries, on empty ``errors`` arrays and on mixed ``cwe`` shapes.
"""

from __future__ import annotations

from pyspark.sql import types as T

_POS = T.StructType(
    [
        T.StructField("line", T.LongType()),
        T.StructField("col", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)

FINDING = T.StructType(
    [
        T.StructField("check_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("start", _POS),
        T.StructField("end", _POS),
        T.StructField(
            "extra",
            T.StructType(
                [
                    T.StructField("message", T.StringType()),
                    T.StructField("severity", T.StringType()),
                    T.StructField("fingerprint", T.StringType()),
                    T.StructField(
                        "metadata",
                        T.StructType(
                            [
                                T.StructField("category", T.StringType()),
                                # string on purpose: an array arrives as its JSON text
                                T.StructField("cwe", T.StringType()),
                                T.StructField("owasp", T.ArrayType(T.StringType())),
                                T.StructField("security-severity", T.StringType()),
                                T.StructField("shortDescription", T.StringType()),
                            ]
                        ),
                    ),
                    T.StructField("engine_kind", T.StringType()),
                    T.StructField("validation_state", T.StringType()),
                    T.StructField("lines", T.StringType()),
                ]
            ),
        ),
    ]
)

SPAN = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("start", _POS),
        T.StructField("end", _POS),
    ]
)

ERROR = T.StructType(
    [
        T.StructField("code", T.LongType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("results", T.ArrayType(FINDING)),
        T.StructField("errors", T.ArrayType(ERROR)),
        T.StructField("paths", T.StructType([T.StructField("scanned", T.ArrayType(T.StringType()))])),
        T.StructField("skipped_rules", T.ArrayType(T.StringType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

# Flat tables: fixed column lists (names and types must stay as they are).
SCAN_RESULTS_DDL = """
    check_id STRING, path STRING,
    start_line BIGINT, start_col BIGINT, start_offset BIGINT,
    end_line BIGINT, end_col BIGINT, end_offset BIGINT,
    message STRING, severity STRING, fingerprint STRING, category STRING,
    cwe STRING, owasp ARRAY<STRING>, security_severity STRING,
    shortDescription STRING, engine_kind STRING, validation_state STRING, lines STRING
"""

SCAN_ERROR_SPANS_DDL = """
    code BIGINT, file STRING,
    start_line BIGINT, start_col BIGINT, start_offset BIGINT,
    end_line BIGINT, end_col BIGINT, end_offset BIGINT
"""

SCAN_ERRORS_DDL = "code BIGINT, level STRING, message STRING, path STRING"

SCAN_SUMMARY_DDL = "version STRING, scanned ARRAY<STRING>, skipped_rules ARRAY<STRING>"

TABLES = {
    "scan_results": SCAN_RESULTS_DDL,
    "scan_error_spans": SCAN_ERROR_SPANS_DDL,
    "scan_errors": SCAN_ERRORS_DDL,
    "scan_summary": SCAN_SUMMARY_DDL,
}

API_DOC_DDL = "doc_id BIGINT, content STRING, api STRING, required_fields ARRAY<STRING>"

INDEX_DDL = "doc_id BIGINT, content STRING, api STRING, required_fields ARRAY<STRING>, vector ARRAY<FLOAT>"

CONVERSATION_DDL = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def ddl_columns(ddl: str) -> list[str]:
    """Column names of a ``name TYPE, ...`` list, in order."""
    return [part.strip().split()[0] for part in _split_top_level(ddl)]


def _split_top_level(ddl: str) -> list[str]:
    parts, depth, cur = [], 0, []
    for ch in ddl:
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
        if ch == "," and depth == 0:
            parts.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
    if "".join(cur).strip():
        parts.append("".join(cur))
    return [p for p in parts if p.strip()]
