"""Stand-in inputs derived from the driver tables (see FIXTURES.md part B).

The reference ships no data, so its inputs are re-derived from the driver's parquet
tables by Spark: ``findings`` (= ``scan_results``) from ``lineitem``, nested
``reports`` from ``orders`` + ``findings``, ``replies`` from ``events``. Everything
is lazy and grows with the tables; no row is invented outside them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanhouse.schemas import FINDING, SPAN

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


#: The lineitem columns that a finding is made of.
LINE_COLUMNS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_discount l_tax l_returnflag l_linestatus".split()


def finding_columns(line: Callable[[str], F.Column]) -> dict[str, F.Column]:
    """A finding's columns by name, from the columns ``line(name)`` of its lineitem."""
    rule = F.pmod(line("l_partkey"), F.lit(100))
    number, quantity, part = line("l_linenumber"), line("l_quantity"), line("l_partkey")
    return {
        "report_id": line("l_orderkey"),
        "check_id": F.concat(F.lit("rule."), _s(rule)),
        "path": F.concat(F.lit("src/"), _s(line("l_suppkey")), F.lit(".c")),
        "start_line": number.cast("bigint"),
        "start_col": quantity.cast("bigint"),
        "start_offset": part,
        "end_line": (number + 1).cast("bigint"),
        "end_col": quantity.cast("bigint") + 5,
        "end_offset": part + 40,
        "message": F.concat(F.lit("message for rule "), _s(rule)),
        "severity": F.when(line("l_returnflag") == "A", "ERROR").when(line("l_returnflag") == "R", "WARNING").otherwise("INFO"),
        "fingerprint": F.concat(F.lit("fp-"), _s(line("l_orderkey")), F.lit("-"), _s(number)),
        "category": F.when(line("l_discount") >= 0.03, "security").otherwise("best-practice"),
        "cwe": F.when(F.pmod(part, F.lit(25)) == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("CWE-"), _s(F.lit(100) + F.pmod(part, F.lit(25))))
        ),
        "owasp": F.when(line("l_tax") >= 0.05, F.array(F.lit("A03:2021"), F.lit("A01:2021"))).otherwise(F.array().cast("array<string>")),
        "security_severity": F.when(line("l_discount") >= 0.07, "High").when(line("l_discount") >= 0.03, "Medium").otherwise("Low"),
        "shortDescription": F.when(line("l_linestatus") == "O", F.concat(F.lit("short "), _s(rule))),
        "engine_kind": F.lit("OSS"),
        "validation_state": F.when(line("l_tax") < 0.02, F.lit("NO_VALIDATOR")),
        "lines": F.concat(F.lit("line "), _s(number)),
    }


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan_results`` stand-in: one finding per lineitem, the 19 table columns plus ``report_id``."""
    return table(spark, sf_dir, "lineitem").select(*[c.alias(n) for n, c in finding_columns(F.col).items()])


def _pos(line, col, offset) -> F.Column:
    return F.struct(line.alias("line"), col.alias("col"), offset.alias("offset"))


def _nested(line: F.Column) -> F.Column:
    """The finding of a lineitem (a struct) as a report holds it."""
    c = finding_columns(lambda name: line[name])
    extra = "message severity fingerprint".split(), "category cwe owasp security_severity shortDescription".split(), "engine_kind validation_state lines".split()
    named = [[c[n].alias(n.replace("security_severity", "security-severity")) for n in part] for part in extra]
    return F.struct(
        c["check_id"].alias("check_id"),
        c["path"].alias("path"),
        _pos(c["start_line"], c["start_col"], c["start_offset"]).alias("start"),
        _pos(c["end_line"], c["end_col"], c["end_offset"]).alias("end"),
        F.struct(*named[0], F.struct(*named[1]).alias("metadata"), *named[2]).alias("extra"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, o_orderpriority, lines``: every order with its lineitems (NULL when none) as they are stored."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS).repartition("l_orderkey")
    nested = lines.groupBy(F.col("l_orderkey").alias("report_id")).agg(F.collect_list(F.struct(*LINE_COLUMNS)).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(nested, orders["o_orderkey"] == nested["report_id"], "left")


def results_of(lines: str) -> F.Column:
    """The findings of a column of lineitems, as a report holds them."""
    return F.coalesce(F.transform(lines, _nested), F.array().cast(T.ArrayType(FINDING)))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested scan reports: one per order, its findings nested (empty array when none).

    ``errors`` are the report's ERROR findings, each with one span (none when
    ``start_col`` is even); ``paths.scanned`` the sorted distinct paths;
    ``skipped_rules`` the sorted distinct INFO rules. The lineitems are collected by report as they
    are stored and become findings after the join, so only their few columns are moved and
    sorted; the join to orders reuses the lineitems' hash partitioning.
    """
    joined, results = order_lines(spark, sf_dir), results_of("lines")

    def to_error(r):
        span = F.struct(
            r["path"].alias("file"),
            r["start"].alias("start"),
            r["end"].alias("end"),
        )
        return F.struct(
            F.pmod(r["start"]["offset"], F.lit(5)).alias("code"),
            F.when(r["start"]["col"] > 25, "warn").otherwise("error").alias("level"),
            r["extra"]["message"].alias("message"),
            r["path"].alias("path"),
            F.when(F.pmod(r["start"]["col"], F.lit(2)) == 0, F.array().cast(T.ArrayType(SPAN)))
            .otherwise(F.array(span))
            .alias("spans"),
        )

    # exploded from an array of one: what later filters and columns ask for doesn't build the findings again
    with_results = joined.select(F.col("o_orderkey").alias("report_id"), F.col("o_orderpriority").alias("version"), F.explode(F.array(results)).alias("results"))
    return with_results.select(
        "report_id",
        "version",
        "results",
        F.transform(F.filter("results", lambda r: r["extra"]["severity"] == "ERROR"), to_error).alias("errors"),
        F.struct(F.array_sort(F.array_distinct(F.transform("results", lambda r: r["path"]))).alias("scanned")).alias("paths"),
        F.array_sort(
            F.array_distinct(F.transform(F.filter("results", lambda r: r["extra"]["severity"] == "INFO"), lambda r: r["check_id"]))
        ).alias("skipped_rules"),
    )



def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Temp views over the driver tables plus ``findings``, for SQL-text queries."""
    for name in TABLE_NAMES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    findings(spark, sf_dir).createOrReplaceTempView("findings")


def register_catalog(spark: SparkSession, sf_dir: str, db: str | None = None) -> str:
    """Catalog (not temp) tables over the driver parquet files; metadata only, no copy. The
    database is named by the folder, so two folders never share one."""
    from scanhouse.session import scratch_dir

    db = db or f"driver_tables_{hashlib.md5(sf_dir.rstrip('/').encode()).hexdigest()[:8]}"
    if not spark.catalog.databaseExists(db):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{scratch_dir(spark, db)}'")
    for name in TABLE_NAMES:
        path = f"{sf_dir.rstrip('/')}/{name}.parquet"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.{name} USING parquet LOCATION '{path}'")
    return db


# Fixed reply bodies used to derive model replies and API responses from ``events``.
MISSING_REPLY = '{"missing_params": ["table"], "message": "Which table do you mean?"}'
DETAIL_422 = (
    '{"detail": [{"type": "missing", "loc": ["body", "table"], "msg": "Field required"}, '
    '{"type": "int_parsing", "loc": ["body", "k"], "msg": "Input should be a valid integer"}, '
    '{"type": "missing", "loc": ["query", "cwe_id"], "msg": "Field required"}]}'
)


# Bodies around the strict grammar, dealt to the events by their id: text after a value, two
# values, single quotes, a raw newline in a string, repeated keys, a fenced block, white space.
ODD_REPLIES = [
    '{"api": "/x", "params": {}} Here is the call.',
    '{"api": "/x", "params": {}}{"api": "/y", "params": {}}',
    "{'api': '/x', 'params': {}}",
    '{"api": "/x\ny", "params": {}}',
    '{"missing_params": "table", "message": "Which one?"}',
    '```json {"api": "/x", "params": {}} ```',
    ' {"api": "/x", "params": {"k": "v"}} ',
    '["api", "params"]',
]
ODD_RESPONSES = [
    '{"a": 1}<html>oops',
    '{"detail": []} and more',
    '[{"a": 1, "a": 2}]',
    '{"detail": null}',
    "{'detail': []}",
    ' {"detail": [{"type": "missing", "loc": ["body", "z"]}]} ',
]


def _odd(bodies: list[str]) -> F.Column:
    """One of the odd bodies for every sixteenth id or so, by turns; else NULL."""
    turn = F.pmod("event_id", F.lit(16 * len(bodies)))
    out = F.lit(None).cast("string")
    for i, body in enumerate(bodies):
        out = F.when(turn == 16 * i + 5, F.lit(body)).otherwise(out)
    return out


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies by event type: missing-params JSON, tool call, other JSON, text, broken JSON,
    and odd bodies among them."""
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    body = (
        F.when(et == "error", F.lit(MISSING_REPLY))
        .when(et == "click", F.concat(F.lit('{"api": "/describe_table", "params": '), F.col("props"), F.lit("}")))
        .when(et == "view", F.col("props"))
        .when(et == "signup", F.concat(F.lit("I could not find a tool for event "), F.col("event_id").cast("string")))
        .otherwise(F.concat(F.lit('{"api": "/query_table", "params": '), F.col("props")))
    )
    return ev.select("event_id", "event_type", "props", F.coalesce(_odd(ODD_REPLIES), body).alias("body"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API responses: status 200/422/500 by ``event_id % 3``; 422 bodies vary by event type, and
    odd bodies come with any status."""
    ev = table(spark, sf_dir, "events")
    status = F.when(F.pmod("event_id", F.lit(3)) == 0, 200).when(F.pmod("event_id", F.lit(3)) == 1, 422).otherwise(500)
    et = F.col("event_type")
    body = (
        F.when(status == 200, F.col("props"))
        .when(status == 500, F.lit("Internal Server Error"))
        .when(et == "signup", F.lit("Unprocessable request"))
        .when(et == "view", F.lit('{"error": "bad input"}'))
        .when(et == "purchase", F.lit('{"detail": "Not authenticated"}'))
        .otherwise(F.lit(DETAIL_422))
    )
    body = F.coalesce(_odd(ODD_RESPONSES), body)
    return ev.select("event_id", "event_type", "props", status.alias("status"), body.alias("body"))
