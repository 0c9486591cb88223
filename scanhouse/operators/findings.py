"""P5-P7 filters and A1-A7 finding reports over a ``scan_results``-shaped DataFrame.

Every aggregate is a partial/final hash aggregate (map-side combine), so a hot key —
one rule, file or CWE holding a third of all findings — costs one small partial row
per task, never a third of the data in one task. Per-key lookups are joins against
those small aggregates (AQE turns them into broadcast joins once their runtime size
is known), never windows partitioned by the hot key over raw rows. Every "first row"
has a total order, so results do not depend on task scheduling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanhouse.functions.partitioning import broadcast_if_small

# Reply texts that must read exactly as the tool replies do.
NO_HIGH_FILES = "There are no files with high-severity vulnerabilities."
HIGH_FILES_FMT = "There are %d files with high-severity vulnerabilities. The file with the most issues is '%s'."
NO_CHECK_INFO = "No information found for this check_id."
FIX_NOT_FOUND = "Not found"

OCCURRENCE_COLS = ["path", "start_line", "start_col", "end_line", "end_col"]
# Total order over a finding, used wherever the tools take "the first row".
_ORDER_COLS = OCCURRENCE_COLS + ["start_offset", "end_offset"]


# ---------------------------------------------------------------- filters (P5-P7)


def filter_security_severity(findings: DataFrame, level: str = "High") -> DataFrame:
    """Case-sensitive equality on ``security_severity``; NULL never matches."""
    return findings.where(F.col("security_severity") == F.lit(level))


def filter_check_id(findings: DataFrame, check_id: str) -> DataFrame:
    return findings.where(F.col("check_id") == F.lit(check_id))


CWE_ID = r"(CWE-[0-9]+)"


def cwe_ids(cwe: Column, match: str = "exact") -> Column:
    """The keys of a finding as an array. ``exact``: the stored text. ``id``: every ``CWE-n`` id in it
    (title or JSON array), each once; empty without one."""
    if match == "exact":
        return F.array(cwe)
    if match == "id":
        return F.array_distinct(F.regexp_extract_all(F.coalesce(cwe, F.lit("")), F.lit(CWE_ID)))
    raise ValueError(f"unknown cwe match mode: {match}")


def filter_cwe(findings: DataFrame, cwe_id: str, match: str = "exact") -> DataFrame:
    if match == "exact":
        return findings.where(F.col("cwe") == F.lit(cwe_id))
    return findings.where(F.array_contains(cwe_ids(F.col("cwe"), match), cwe_id))


# ---------------------------------------------------------------- aggregates (A1-A7)


def severity_counts(findings: DataFrame) -> DataFrame:
    """A1: ``severity, count`` by count descending (severity breaks ties)."""
    return (
        findings.groupBy("severity")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc_nulls_first("severity"))
    )


def vulnerability_summary(findings: DataFrame) -> DataFrame:
    """A2: A1 plus the grand total on every row, from one scan of the findings.

    The total is a window over the (few-row) aggregate, not a second pass over data. A seed
    row keeps one row, with no severity and total 0, when there are no findings.
    """
    from pyspark.sql import Window

    rows = findings.select("severity", F.lit(1).alias("one"))
    seed = findings.sparkSession.range(1).select(F.lit(None).cast(findings.schema["severity"].dataType).alias("severity"), F.lit(0).alias("one"))
    counts = rows.unionByName(seed).groupBy("severity").agg(F.sum("one").alias("count"))
    with_total = counts.withColumn("total", F.sum("count").over(Window.partitionBy()))
    return with_total.where("count > 0 or total = 0").orderBy(F.desc("count"), F.asc_nulls_first("severity"))


def high_severity_files(findings: DataFrame, top_n: int = 50, level: str = "High") -> DataFrame:
    """A3: files with the most ``level`` findings, top ``top_n`` (TakeOrderedAndProject)."""
    return (
        filter_security_severity(findings, level)
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("high_count"))
        .orderBy(F.desc("high_count"), F.asc_nulls_first("path"))
        .limit(int(top_n))
    )


def high_severity_headline(top: DataFrame) -> DataFrame:
    """A3b: one ``summary`` row over the A3 result (counts the returned rows, as the tool does)."""
    n = F.count(F.lit(1))
    worst = F.min_by(F.col("path"), F.struct((-F.col("high_count")).alias("k"), F.col("path")))
    agg = top.agg(n.alias("n"), worst.alias("worst"))
    return agg.select(
        F.when(F.col("n") == 0, F.lit(NO_HIGH_FILES))
        .otherwise(F.format_string(HIGH_FILES_FMT, F.col("n"), F.col("worst")))
        .alias("summary")
    )


def cwe_summary(findings: DataFrame, normalize: bool = False) -> DataFrame:
    """A4: ``cwe, cnt``; NULL is its own group.

    ``normalize`` rewrites JSON-array text to one canonical spelling first, so equal
    arrays written with different spacing form one group.
    """
    cwe = F.col("cwe")
    if normalize:
        as_array = F.from_json(cwe, "array<string>")
        cwe = F.when(F.ltrim(cwe).startswith("["), F.coalesce(F.to_json(as_array), cwe)).otherwise(cwe)
    return (
        findings.groupBy(cwe.alias("cwe"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc_nulls_first("cwe"))
    )


def _rule_messages(findings: DataFrame) -> DataFrame:
    """One row per rule: its message from the first occurrence in total order, and its size."""
    order = F.struct(*[F.col(c) for c in _ORDER_COLS], F.col("message"))
    return findings.groupBy("check_id").agg(
        F.min_by("message", order).alias("message"),
        F.count(F.lit(1)).alias("n_occurrences"),
    )


def _absent_row(scoped: DataFrame, check_id: str, **cols: F.Column) -> DataFrame:
    """One row for an id with no findings, none otherwise — from a global count over the
    (filtered) findings, so no join against a literal key is needed."""
    n = scoped.agg(F.count(F.lit(1)).alias("_n"))
    return n.where(F.col("_n") == 0).select(F.lit(check_id).cast("string").alias("check_id"), *[c.alias(k) for k, c in cols.items()])


def explain_check_flat(findings: DataFrame, check_id: str | None = None) -> DataFrame:
    """A5, flat: one row per occurrence with the rule's message.

    ``check_id=None`` explains every rule. An absent id gives one row with the fixed
    message and NULL positions. The rules' messages are a small aggregate: counted, and
    broadcast while small, so that the findings themselves don't move.
    """
    scoped = findings if check_id is None else filter_check_id(findings, check_id)
    occ = scoped.select("check_id", *OCCURRENCE_COLS)
    msgs = broadcast_if_small(_rule_messages(scoped).select("check_id", "message"))
    out = occ.join(msgs, "check_id").select("check_id", "message", *OCCURRENCE_COLS)
    if check_id is None:
        return out
    types = dict(findings.select(*OCCURRENCE_COLS).dtypes)
    absent = _absent_row(
        scoped,
        check_id,
        message=F.lit(NO_CHECK_INFO),
        **{c: F.lit(None).cast(types[c]) for c in OCCURRENCE_COLS},
    )
    return out.unionByName(absent)


def _array_of(rows: Column, times: Column) -> Column:
    """Sorted array of structs, each repeated ``times`` times (equal rows come counted)."""
    return F.array_sort(F.flatten(F.collect_list(F.array_repeat(rows, times.cast("int")))))


def explain_check(findings: DataFrame, check_id: str | None = None, page_size: int | None = None) -> DataFrame:
    """A5, nested: ``check_id, message, page, occurrences array<struct<path,start_line,...>>``.

    One row per rule, page 0, as the tool replies; equal findings are counted before they are
    gathered. For rules that are too frequent for one array, the caller sets ``page_size``:
    every rule then has ``ceil(n / page_size)`` pages, and the page follows from the finding's
    content, so that a retried task gives the same pages. All occurrences are kept. An absent id
    gives one row with the fixed message, page 0 and an empty array.
    """
    scoped = findings if check_id is None else filter_check_id(findings, check_id)
    counted = scoped.groupBy("check_id", *OCCURRENCE_COLS).agg(F.count(F.lit(1)).alias("_n"))
    occ = counted.join(broadcast_if_small(_rule_messages(scoped)), "check_id")
    page = F.lit(0).cast("long")
    if page_size is not None:
        n_pages = F.greatest(F.lit(1), F.ceil(F.col("n_occurrences") / F.lit(int(page_size)))).cast("long")
        page = F.pmod(F.xxhash64(*OCCURRENCE_COLS), n_pages)
    nested = (
        occ.withColumn("page", page)
        .groupBy("check_id", "message", "page")
        .agg(_array_of(F.struct(*OCCURRENCE_COLS), F.col("_n")).alias("occurrences"))
    )
    if check_id is None:
        return nested
    absent = _absent_row(
        scoped,
        check_id,
        message=F.lit(NO_CHECK_INFO),
        page=F.lit(0).cast("long"),
        occurrences=F.array().cast(nested.schema["occurrences"].dataType),
    )
    return nested.unionByName(absent)


def _files_by_cwe(findings: DataFrame, cwe_id: str | None, match: str) -> tuple[DataFrame, DataFrame]:
    """``(cwe, path, count)`` and ``(cwe, total_count)``; a finding with several ids counts for each."""
    keyed = findings.select(F.explode_outer(cwe_ids(F.col("cwe"), match)).alias("cwe"), "path")
    if cwe_id is not None:
        keyed = keyed.where(F.col("cwe") == F.lit(cwe_id))
    per_file = keyed.groupBy("cwe", "path").agg(F.count(F.lit(1)).alias("count"))
    return per_file, per_file.groupBy("cwe").agg(F.sum("count").alias("total_count"), F.count(F.lit(1)).alias("n_files"))


def _no_cwe(totals: DataFrame, cwe_id: str) -> DataFrame:
    """One row with the id if there are no totals, none otherwise."""
    return totals.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(F.lit(cwe_id).alias("cwe"))


def findings_by_cwe(findings: DataFrame, cwe_id: str | None = None, match: str = "exact") -> DataFrame:
    """A6: ``cwe, path, count, total_count`` — files per CWE and the CWE's total.

    ``cwe_id=None`` reports every CWE (NULL included as a group). The total is a second
    aggregate over the small per-file aggregate, joined back null-safely. An absent id gives
    one row without a path, count and total 0.
    """
    per_file, totals = _files_by_cwe(findings, cwe_id, match)
    totals = totals.select(F.col("cwe").alias("t_cwe"), "total_count")
    out = per_file.join(totals, per_file["cwe"].eqNullSafe(totals["t_cwe"])).select("cwe", "path", "count", "total_count")
    if cwe_id is not None:
        zero = F.lit(0).cast("long")
        out = out.unionByName(_no_cwe(totals, cwe_id).select("cwe", F.lit(None).cast("string").alias("path"), zero.alias("count"), zero.alias("total_count")))
    return out.orderBy(F.asc_nulls_first("cwe"), F.desc("count"), F.asc_nulls_first("path"))


def findings_by_cwe_nested(
    findings: DataFrame, cwe_id: str | None = None, match: str = "exact", page_size: int | None = None
) -> DataFrame:
    """A6, tool shape: ``cwe, total_count, page, files array<struct<path,count>>``.

    One row per CWE, page 0; an absent id gives total 0 and no files. For a CWE in too many
    files for one array, the caller sets ``page_size``: every CWE then has
    ``ceil(n_files / page_size)`` pages by a hash of the path; every file is kept.
    """
    per_file, totals = _files_by_cwe(findings, cwe_id, match)
    totals = totals.withColumnRenamed("cwe", "t_cwe")
    keyed = per_file.join(totals, per_file["cwe"].eqNullSafe(totals["t_cwe"]))
    page = F.lit(0).cast("long")
    if page_size is not None:
        n_pages = F.greatest(F.lit(1), F.ceil(F.col("n_files") / F.lit(int(page_size)))).cast("long")
        page = F.pmod(F.xxhash64("path"), n_pages)
    nested = keyed.withColumn("page", page).groupBy("cwe", "total_count", "page").agg(
        F.array_sort(F.collect_list(F.struct("path", "count"))).alias("files")
    )
    if cwe_id is None:
        return nested
    zero = F.lit(0).cast("long")
    none = _no_cwe(totals, cwe_id).select("cwe", zero.alias("total_count"), zero.alias("page"), F.array().cast(nested.schema["files"].dataType).alias("files"))
    return nested.unionByName(none)


def fix_context(findings: DataFrame, check_id: str | None = None) -> DataFrame:
    """A7: one ``(check_id, shortDescription, message)`` per rule, first occurrence in total order.

    An absent id gives the fixed "Not found" row with an empty shortDescription.
    """
    order = F.struct(*[F.col(c) for c in _ORDER_COLS], F.col("shortDescription"), F.col("message"))
    first = F.min_by(F.struct("shortDescription", "message"), order).alias("first")
    if check_id is None:
        picked = findings.groupBy("check_id").agg(first)
        return picked.select("check_id", F.col("first.shortDescription").alias("shortDescription"), F.col("first.message").alias("message"))
    # one id: a global aggregate always yields exactly one row, found or not (no join)
    picked = filter_check_id(findings, check_id).agg(F.count(F.lit(1)).alias("_n"), first)
    found = F.col("_n") > 0
    return picked.select(
        F.lit(check_id).cast("string").alias("check_id"),
        F.when(found, F.col("first.shortDescription")).otherwise(F.lit("")).alias("shortDescription"),
        F.when(found, F.col("first.message")).otherwise(F.lit(FIX_NOT_FOUND)).alias("message"),
    )
