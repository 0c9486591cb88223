"""H1-H8: conversation history, message lists, prompts, and reply classification.

All but H1 are row-wise column expressions (JSON parsing, higher-order array/map
functions) — narrow, no grouping. H1 needs order within a conversation; it is planned
so that no conversation, however long, becomes one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanhouse.session import ensure_checkpoint_dir

# Chat-memory line prefixes (library defaults of the chat memory),
# the API-failure reply format, and the role given to history in the message list.
HUMAN_PREFIX = "Human"
AI_PREFIX = "AI"
API_FAILED_FMT = "API 呼叫失敗: %d, %s"
HISTORY_ROLE = "user"

# nothing but white space, as Unicode has it (the separators \x1c-\x1f included)
BLANK = r"^[\s\x1c-\x1f\x85\p{Z}]*$"

REPAIR_PROMPT_FMT = (
    "A request to %s was refused because arguments are absent or wrong. The service said:\n"
    "%s\n"
    "Search the conversation for the values it asks for. Reply with a single JSON object and no other text.\n"
    'With every value found: the path under "api", and under "params" an object of names and values.\n'
    'With any value not found: the names still needed as a list under "missing_params", and under "message" '
    "a question that asks the user for them.\n"
    "A value that the conversation does not state counts as not found; leave none blank."
)


def _line(role: Column, text: Column) -> Column:
    prefix = F.when(role == "user", F.lit(HUMAN_PREFIX)).when(role == "assistant", F.lit(AI_PREFIX)).otherwise(role)
    return F.concat(prefix, F.lit(": "), text)


def _last_n(arr: Column, n: int) -> Column:
    return F.reverse(F.slice(F.reverse(arr), 1, n))


def history_window(
    conv: DataFrame,
    k: int = 1,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """H1: ``conv_id, turn, role, text, history`` for every non-system message.

    ``history`` holds the previous ``k`` exchanges (``2k`` messages) as
    ``Human: …`` / ``AI: …`` lines joined by newlines ('' for the first message).

    Plan: messages are range-partitioned by (conversation, turn), so a conversation is cut
    by the rank of its messages, whatever its turn numbers are; the sorted rows and their
    partition number are checkpointed to the shared folder, which fixes the cut. A window
    per (conversation, partition) supplies the previous lines; the last ``2k`` lines of each
    partition's share, one row per conversation and partition, carry on into the next ones.
    A conversation with a third of all rows is spread over a third of the partitions
    (``partitions``: their number, else Spark's own setting).
    """
    n = 2 * int(k)
    entry = F.struct(F.col(turn_col).alias("t"), F.col("line").alias("line"))
    base = conv.where(F.col(role_col) != "system").select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
        _line(F.col(role_col), F.col(text_col)).alias("line"),
    )
    if n == 0:
        return base.select(F.col("conv_id").alias(conv_col), F.col(turn_col), "role", "text", F.lit("").alias("history"))
    by = ["conv_id", turn_col]
    ranged = base.repartitionByRange(int(partitions), *by) if partitions else base.repartitionByRange(*by)
    ensure_checkpoint_dir(conv.sparkSession)
    msgs = ranged.sortWithinPartitions(*by).withColumn("seg", F.spark_partition_id()).checkpoint()
    w_in = Window.partitionBy("conv_id", "seg").orderBy(turn_col).rowsBetween(-n, -1)
    w_back = Window.partitionBy("conv_id", "seg").orderBy(F.desc(turn_col))
    within = msgs.withColumn("prev", F.collect_list(entry).over(w_in)).withColumn("from_end", F.row_number().over(w_back))
    # only a share's last n lines are collected, so a tail never exceeds n entries
    tails = (
        within.where(F.col("from_end") <= n)
        .groupBy("conv_id", "seg")
        .agg(F.array_sort(F.collect_list(entry)).alias("tail"))
    )
    w_seg = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(-n, -1)
    carry = tails.select(
        "conv_id",
        "seg",
        _last_n(F.array_sort(F.flatten(F.collect_list("tail").over(w_seg))), n).alias("carry"),
    )
    joined = within.join(carry, ["conv_id", "seg"], "left")
    last = _last_n(F.array_sort(F.concat(F.coalesce(F.col("carry"), F.array().cast(joined.schema["prev"].dataType)), F.col("prev"))), n)
    return joined.select(
        F.col("conv_id").alias(conv_col),
        F.col(turn_col),
        "role",
        "text",
        F.concat_ws("\n", F.transform(last, lambda e: e["line"])).alias("history"),
    )


def build_messages(df: DataFrame, system_col: str, history_col: str = "history", user_col: str = "text") -> DataFrame:
    """H2: add ``messages array<struct<role,content>>`` = system, history (if not empty), user."""
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))
    hist = F.filter(F.array(msg(HISTORY_ROLE, F.col(history_col))), lambda m: F.coalesce(m["content"], F.lit("")) != "")
    return df.withColumn(
        "messages",
        F.concat(F.array(msg("system", F.col(system_col))), hist, F.array(msg("user", F.col(user_col)))),
    )


def repair_prompt(df: DataFrame, api_col: str = "api", error_col: str = "body") -> DataFrame:
    """H3: add ``system_prompt`` built from the API path and the error body."""
    return df.withColumn("system_prompt", F.format_string(REPAIR_PROMPT_FMT, F.col(api_col), F.col(error_col)))


_STRICT = {"allowSingleQuotes": "false"}


def _wrapped(body: Column) -> Column:
    """Whether the text is right inside an object. Spark's parsers stop after the first value; a
    text that is right inside an object and one element inside an array is a single whole value."""
    schema = "struct<v: string, broken: string>"
    options = _STRICT | {"columnNameOfCorruptRecord": "broken"}
    return F.from_json(F.concat(F.lit('{"v":'), body, F.lit("}")), schema, options)["broken"].isNull()


def is_json(body: Column) -> Column:
    """Whether the whole text is one JSON value, by the strict grammar (with NaN and Infinity).
    NULL is not JSON."""
    in_array = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>", _STRICT)
    return F.coalesce((F.size(in_array) == 1) & _wrapped(body), F.lit(False))


def json_keys(body: Column) -> Column:
    """Top-level keys of a strictly valid JSON object; NULL for everything else."""
    in_array = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<map<string,string>>", _STRICT)
    keys = F.when(F.size(in_array) == 1, F.map_keys(in_array[0]))
    return F.when(body.rlike(r"^\s*\{") & _wrapped(body), keys)


_REPLY_FIELDS = "struct<api: string, params: map<string, string>, missing_params: array<string>, message: string>"


def parse_reply(df: DataFrame, body_col: str = "body") -> DataFrame:
    """H4: classify a model reply: ``kind`` in {empty, text, missing, call, unexpected},
    plus ``api``, ``params map<string,string>``, ``missing array<string>``, ``message`` (of a
    missing reply) and ``raw`` (the whole text of a missing or unexpected reply).

    Only a strictly valid JSON text counts as JSON; anything around the value makes it text.
    Key *presence* decides (a key with a null value still counts): ``missing_params``
    first, then ``api`` and ``params``. Non-object JSON is ``unexpected``. A repeated key
    keeps its last value.
    """
    body = F.col(body_col)
    # staged projections, so that keys and kind are found once per reply
    staged = df.select("*", json_keys(body).alias("_keys"))
    keys = F.col("_keys")
    has = lambda k: F.coalesce(F.array_contains(keys, F.lit(k)), F.lit(False))
    kind = (
        F.when(body.isNull(), "empty")
        .when(keys.isNull(), F.when(is_json(body), "unexpected").otherwise("text"))
        .when(has("missing_params"), "missing")
        .when(has("api") & has("params"), "call")
        .otherwise("unexpected")
    )
    staged = staged.select("*", kind.alias("kind"))
    call, missing = F.col("kind") == "call", F.col("kind") == "missing"
    fields = F.when(call | missing, F.from_json(body, _REPLY_FIELDS, _STRICT))
    staged = staged.select("*", fields.alias("_f"))
    return staged.select(
        *[F.col(f"`{c}`") for c in df.columns],
        "kind",
        F.when(call, F.col("_f.api")).alias("api"),
        F.when(call, F.col("_f.params")).alias("params"),
        F.when(missing, F.col("_f.missing_params")).alias("missing"),
        F.when(missing, F.col("_f.message")).alias("message"),
        F.when(F.col("kind").isin("missing", "unexpected"), body).alias("raw"),
    )


_DETAIL_SCHEMA = "struct<detail: array<struct<type: string, loc: array<string>>>>"


def missing_fields(body: Column) -> Column:
    """H6: last ``loc`` item of every ``detail`` entry whose ``type`` is ``missing``.

    Never NULL: a body that is not JSON, or whose ``detail`` is not a list, gives [].
    """
    detail = F.when(is_json(body), F.from_json(body, _DETAIL_SCHEMA, _STRICT))["detail"]
    picked = F.transform(F.filter(detail, lambda d: d["type"] == "missing"), lambda d: F.try_element_at(d["loc"], F.lit(-1)))
    return F.coalesce(picked, F.array().cast("array<string>"))


def classify_response(
    df: DataFrame, status_col: str = "status", body_col: str = "body", require_missing: bool = False
) -> DataFrame:
    """H5: ``kind`` in {ok, needs_arguments, failed} and ``message``.

    200 with a JSON body -> ok. 422 with a JSON object holding ``detail`` ->
    needs_arguments (with ``require_missing``, only if at least one field is missing).
    Anything else -> failed, message ``API 呼叫失敗: <status>, <body>``.
    """
    status, body = F.col(status_col), F.col(body_col)
    keyed = df.select("*", json_keys(body).alias("_keys"))  # found once per body
    keys = F.col("_keys")
    json_ok = keys.isNotNull() | is_json(body)
    has_detail = F.coalesce(F.array_contains(keys, F.lit("detail")), F.lit(False))
    repairable = (status == 422) & has_detail
    if require_missing:
        repairable = repairable & (F.size(missing_fields(body)) > 0)
    kind = F.when((status == 200) & json_ok, "ok").when(repairable, "needs_arguments").otherwise("failed")
    # the kind is computed once (its own projection), then the message reads it
    staged = keyed.select(*[F.col(f"`{c}`") for c in df.columns], kind.alias("kind"))
    k = F.col("kind")
    message = (
        F.when(k == "failed", F.format_string(API_FAILED_FMT, status, F.coalesce(body, F.lit(""))))
        .when(k == "needs_arguments", F.coalesce(F.get_json_object(body, "$.detail"), F.lit("null")))
        .otherwise(body)
    )
    return staged.select("*", message.alias("message"))


def blank_required(required: Column, payload: Column) -> Column:
    """H7: required fields that are absent, empty or only white space in ``payload``."""
    return F.filter(required, lambda f: F.coalesce(F.try_element_at(payload, f), F.lit("")).rlike(BLANK))


def merge_payload(payload: Column, extra: Column) -> Column:
    """H8: ``payload`` with ``extra`` merged in (``extra`` wins); NULL on either side is empty.

    Keys of ``extra`` are removed from ``payload`` first — a plain ``map_concat`` would
    fail on the duplicate key.
    """
    empty = F.create_map().cast("map<string,string>")
    base, extra = F.coalesce(payload, empty), F.coalesce(extra, empty)
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(extra), k))
    return F.map_concat(kept, extra)
